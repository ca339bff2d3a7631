"""Held-out passages inside a training corpus (problem 8), found with an FM-index over each shard of documents.

A shard is a bounded stretch of a scan partition; it is built, searched and dropped inside one task, so no text is
shuffled and memory doesn't grow with the corpus. Texts become sequences of words (each ideograph is one). Words that
no test item holds can't take part in a match: each stretch of them becomes one separator, as does each document's
end. The suffix array of that sequence gives the Burrows-Wheeler transform, a wavelet matrix over it answers ranks, and
all phrases of all items are searched backwards at once, as arrays. Occurrences are located by walking to sampled
suffix positions. Located phrases on one diagonal form exact runs; where an item has a phrase in a document, its longest
common subsequence with the whole document is measured. The parts of a document that belong to an item are merged into
spans for removal.

Phrases have three words: an item of nine words or more of which no more than a quarter is replaced keeps one of that
length, so the search loses none of those. What is measured after that isn't bound to the places of phrases. A phrase may
stand in many items and many documents: located places are expanded to items in portions of bounded size. Items are the
stated query set: they are taken in blocks of bounded size, and each block is searched in all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE, JOIN, SAMPLE = 3, 4, 8
SHARD_WORDS = 400_000
BLOCK_CHARS = 4_000_000
#: So many places of phrases in items are held at a time.
PORTION = 2_000_000
SEPARATOR, FIRST = 1, 2
RESULT = "item_id bigint, doc_id bigint, rule string, longest_run bigint, share double, spans array<struct<first:bigint,last:bigint>>"

_WORD = re.compile(r"[㐀-鿿豈-﫿぀-ヿ]|[^\W_㐀-鿿豈-﫿぀-ヿ]+")
_HIDDEN = re.compile("[\xad​-‏‪-‮⁠-⁯﻿︀-️'’ʼ]")


def words_of(text: str) -> list[str]:
    """Case, width, punctuation, spacing and what shows nothing make no difference."""
    return _WORD.findall(unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold())


class Items:
    """The query set: each item as word numbers, its kind, and its phrases."""

    def __init__(self, rows: list[tuple[int, str | None, str]], run_words: int = 12, run_chars: int = 24, share: float = 0.75):
        self.ids, self.seq, self.need, self.share = [], [], [], share
        vocabulary: dict[str, int] = {}
        for item, _, text in rows:
            words = words_of(text or "")
            if len(words) < PHRASE:
                continue
            self.ids.append(item)
            self.seq.append(np.array([vocabulary.setdefault(w, FIRST + len(vocabulary)) for w in words]))
            han = sum(len(w) == 1 and not w.isascii() for w in words)
            self.need.append(run_chars if han * 2 > len(words) else run_words)
        self.vocabulary = vocabulary
        self.bits = max(2, int(FIRST + len(vocabulary)).bit_length())
        # Each distinct phrase is searched once; where it stands in which items is kept beside it.
        grams = [np.lib.stride_tricks.sliding_window_view(s, PHRASE) for s in self.seq]
        if grams:
            every = np.concatenate(grams)
            self.phrases, inverse = np.unique(every, axis=0, return_inverse=True)
            owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(inverse.ravel(), kind="stable")
            self.owner, self.place = owner[order], place[order]
            self.key = inverse.ravel()[order] * len(grams) + self.owner  # ascending: by phrase, then by item
            self.first = np.r_[0, np.cumsum(np.bincount(inverse.ravel(), minlength=len(self.phrases)))]
        else:
            self.phrases = np.zeros((0, PHRASE), int)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Every separator counts as a symbol of its own, ordered by position, so the
    doubling ends at the longest stretch between separators."""
    n = len(seq)
    apart = seq == SEPARATOR
    rank = np.where(apart, np.cumsum(apart) - 1, seq + int(apart.sum())).astype(np.int64)
    width = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if rank.max() == n - 1:
            return order
        width *= 2
        if width >= n:
            return np.argsort(rank, kind="stable")


class Index:
    """FM-index of one shard: counts, a wavelet matrix over the transform, sampled suffix positions."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        order = suffix_array(seq)
        self.transform = seq[order - 1]  # the first suffix is preceded by the last symbol, a separator
        self.count = np.r_[0, np.cumsum(np.bincount(seq, minlength=1 << bits))]
        level, self.ones, self.zeros = self.transform.copy(), [], []
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        starts = np.r_[True, seq[:-1] == SEPARATOR]  # a walk never has to pass a separator
        sampled = starts | (np.arange(self.n) % SAMPLE == 0)
        self.kept = sampled[order]
        self.position = np.where(self.kept, order, -1)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low = np.zeros_like(row)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ones[k], (symbol >> b) & 1
            low = np.where(bit == 1, self.zeros[k] + ones[low], low - ones[low])
            row = np.where(bit == 1, self.zeros[k] + ones[row], row - ones[row])
        return row - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each phrase, as [low, high)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            low = self.count[symbol] + self.rank(symbol, low)
            high = self.count[symbol] + self.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, at, todo = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.position[at[done]] + steps
            todo, at = todo[~done], at[~done]
            symbol = self.transform[at]
            at = self.count[symbol] + self.rank(symbol, at)
            steps += 1
        return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = masks.get(y)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _spans(at: np.ndarray, length: int, real: np.ndarray) -> list[dict]:
    """Merged spans, in words of the document, of phrases that begin at sorted positions ``at``."""
    cut = np.flatnonzero(np.diff(at) > length + JOIN) + 1
    return [{"first": int(real[g[0]]), "last": int(real[g[-1] + length - 1])} for g in np.split(at, cut) if len(g)]


def search_shard(ids: list[int], docs: list[list[str]], items: Items) -> list[tuple]:
    """Rows of RESULT for the documents of one shard."""
    if not len(items.phrases):
        return []
    get = items.vocabulary.get
    seqs, reals = [], []
    for words in docs:
        seq = np.fromiter((get(w, SEPARATOR) for w in words), np.int64, len(words))
        seq = np.r_[seq, SEPARATOR]
        keep = np.r_[True, (seq[1:] != SEPARATOR) | (seq[:-1] != SEPARATOR)]
        seqs.append(seq[keep])
        reals.append(np.flatnonzero(keep))
    start = np.r_[0, np.cumsum([len(s) for s in seqs])]
    seq = np.concatenate(seqs)
    index = Index(seq, items.bits)
    low, high = index.search(items.phrases)
    found = high - low
    if not found.sum():
        return []
    rows = np.repeat(low - np.r_[0, np.cumsum(found)[:-1]], found) + np.arange(found.sum())
    phrase = np.repeat(np.arange(len(found)), found)
    at = index.locate(rows)
    doc = np.searchsorted(start, at, side="right") - 1
    order = np.argsort(doc, kind="stable")
    at, phrase, doc = at[order], phrase[order], doc[order]
    out: list[tuple] = []
    # Portions of whole documents; a document whose phrases stand in very many items is taken by ranges of items.
    size = np.cumsum(np.diff(items.first)[phrase])
    borders = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
    a = 0
    while a < len(borders) - 1:
        done = size[borders[a] - 1] if borders[a] else 0
        z = max(a + 1, int(np.searchsorted(size[borders[a + 1 :] - 1], done + PORTION, side="right")) + a)
        part = slice(borders[a], borders[z])
        ranges = max(1, -(-int(size[borders[z] - 1] - done) // PORTION))
        cuts = np.linspace(0, len(items.ids), min(ranges, len(items.ids)) + 1).astype(int)
        for low_item, high_item in zip(cuts[:-1], cuts[1:], strict=True):
            out += _measure(ids, items, seq, start, reals, at[part], phrase[part], doc[part], int(low_item), int(high_item))
        a = z
    return out


def _measure(ids: list[int], items: Items, seq: np.ndarray, start: np.ndarray, reals: list[np.ndarray], at: np.ndarray, phrase: np.ndarray, doc: np.ndarray, low_item: int, high_item: int) -> list[tuple]:
    """Rows of RESULT for some located phrases, of the items from low_item to high_item alone."""
    # Every occurrence of a phrase counts for every place that the phrase has in an item.
    n = len(items.ids)
    first = np.searchsorted(items.key, phrase * n + low_item)
    places = np.searchsorted(items.key, phrase * n + high_item) - first
    if not places.sum():
        return []
    which = np.repeat(first - np.r_[0, np.cumsum(places)[:-1]], places) + np.arange(places.sum())
    at, doc, owner, place = np.repeat(at, places), np.repeat(doc, places), items.owner[which], items.place[which]
    order = np.lexsort((place, at - place, owner, doc))
    at, owner, place, doc = at[order], owner[order], place[order], doc[order]
    diagonal = at - place
    same = (doc[1:] == doc[:-1]) & (owner[1:] == owner[:-1])
    run = np.r_[True, ~(same & (diagonal[1:] == diagonal[:-1]) & (place[1:] == place[:-1] + 1))]
    begins = np.flatnonzero(run)
    lengths = np.diff(np.r_[begins, len(at)]) + PHRASE - 1
    groups = np.flatnonzero(np.r_[True, ~same])
    longest = np.maximum.reduceat(lengths, np.searchsorted(begins, groups))
    out = []
    for g, (a, z) in enumerate(zip(groups, np.r_[groups[1:], len(at)], strict=True)):
        item, d = owner[a], doc[a]
        target, need = items.seq[item], int(np.ceil(items.share * len(items.seq[item])))
        here = np.unique(at[a:z])
        base = start[d]
        distinct, times = np.unique(target, return_counts=True)
        wanted = np.zeros(1 << items.bits, bool)
        wanted[distinct] = True
        share, rule = 0.0, "run" if longest[g] >= items.need[item] else ""
        body = seq[base : start[d + 1]]
        body = body[wanted[body]]  # other words are in no common subsequence
        if rule or len(body) >= need:
            known = np.bincount(body, minlength=len(wanted))[distinct]
            if rule or np.minimum(known, times).sum() >= need:
                common = common_length(target, body)
                share = common / len(target)
                rule = rule or ("share" if common >= need else "")
        if rule:
            out.append((items.ids[item], ids[d], rule, int(longest[g]), float(share), _spans(here - base, PHRASE, reals[d])))
    return out


def _searcher(rows: list[tuple], shard_words: int, **rules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(rows, **rules)
        ids: list[int] = []
        docs: list[list[str]] = []
        held = 0

        def flush() -> pd.DataFrame:
            found = search_shard(ids, docs, items)
            return pd.DataFrame(found, columns=["item_id", "doc_id", "rule", "longest_run", "share", "spans"])

        for batch in batches:
            for ident, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                ids.append(int(ident))
                docs.append(words)
                held += len(words) + 1
                if held >= shard_words:
                    yield flush()
                    ids, docs, held = [], [], 0
        if docs:
            yield flush()

    return run


def leaked(documents: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS, **rules: float) -> DataFrame:
    """item_id, doc_id, rule ('run' or 'share'), longest_run, share, spans: the items of which documents contain

    ``run_words`` (12) consecutive words, or ``run_chars`` (24) consecutive characters of an item that is mostly
    ideographs, or, in order, ``share`` (0.75) of the item. spans are merged ranges of word numbers of the document.
    Null and empty texts hold nothing; items of fewer than three words are never found; equal documents are each
    reported; further columns are not read. Items are read to the driver in blocks of at most ``block_chars`` characters
    (one item at least), and each block is searched in all documents.
    """
    spark = documents.sparkSession
    docs = documents.filter("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few and large files: spread the texts
        docs = docs.repartition(4 * spark.sparkContext.defaultParallelism)
    queries = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "lang", "text")
    out, block, size = None, [], 0

    def search(rows: list[tuple], so_far: DataFrame | None) -> DataFrame:
        found = docs.mapInPandas(_searcher(rows, shard_words, **rules), RESULT)
        return found if so_far is None else so_far.unionByName(found)

    for row in queries.toLocalIterator():
        if block and size + len(row.text) > block_chars:
            out, block, size = search(block, out), [], 0
        block.append((row.item_id, row.lang, row.text))
        size += len(row.text)
    return search(block, out)


def removal_spans(found: DataFrame) -> DataFrame:
    """doc_id, items, first, last: the merged spans of each document that belong to any item."""
    spans = found.select("doc_id", "item_id", F.inline("spans"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "last")))
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def add(done, span):
        top = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], span["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1), joined).otherwise(F.concat(done, F.array(span)))

    merged = spans.groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"), ordered.alias("s"))
    return merged.select("doc_id", "items", F.inline(F.aggregate("s", empty, add)))
