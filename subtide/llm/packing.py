"""Documents in containers of fixed capacity (problem 7): best fit, decreasing, with conflicts.

Sizes are counted with a public tokenizer. Only identifiers, sizes and hashes are shuffled: documents are spread by a hash
of their id over shards of at most ``SHARD`` items, and each shard is packed by one task, so no group grows with the corpus.
Within a shard the bins are ordered by their residual, and each bin carries bitmaps of the sources and of the clusters of
near-duplicates that it holds. The successor of an item's size among the residuals is the tightest bin; while that bin
conflicts the search goes on to the next. Where every bin with room conflicts, the tightest of them is taken rather than a
new one, since unused space counts first; ``strict`` opens a new bin instead.

Near-duplicates are texts whose runs of five words have a similarity of 0.8 or more. A cluster is the least hash of a text's
runs under one of ``HASHES`` functions: two such texts share at least one of them but for one pair in 600, and equal
texts share all. Clusters keep copies apart; they decide nothing else.

An item above the capacity fills containers of its own, and only its rest is packed. The loss of sharding is one
underfull bin or so per shard.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.functions.columns import let

CAPACITY, SHARD, HASHES, RUN = 2048, 20_000, 4, 5
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PACKED = "doc_id bigint, part bigint, tokens bigint, first_token bigint, bin bigint, conflict boolean"


def token_counter(path: str = TOKENIZER):
    """A pandas UDF that counts tokens; the tokenizer is loaded once per task and never downloaded."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            counts: list[int] = []
            for at in range(0, len(texts), 256):
                part = [t or "" for t in texts.iloc[at : at + 256]]
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            yield pd.Series(counts, dtype="int64")

    return count


def clusters(text: Column) -> Column:
    """array<bigint>: under each of ``HASHES`` functions the least hash of the runs of ``RUN`` words; of a shorter text, the
    hash of all its words. Case and punctuation don't count, and each ideograph is a word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\x{3400}-\x{9FFF}]|[\p{L}\p{N}&&[^\x{3400}-\x{9FFF}]]+"), F.lit(0))

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - RUN + 1)), lambda i: F.xxhash64(F.slice(w, i, RUN)))

    least = lambda hashes: F.array(*[F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k)))) for k in range(HASHES)])
    return let(words, lambda w: let(runs(w), least))


def best_fit(sizes: list[int], sources: list[int], groups: list[tuple[int, ...]], capacity: int = CAPACITY, strict: bool = False) -> tuple[list[int], list[bool]]:
    """The bin of each item, and whether it shares the bin with its source or one of its groups.

    sources: small numbers, -1 for an item without one; groups: the small numbers of the clusters that an item is in.
    """
    bins_at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # by residual, in order of arrival
    occupied = 0  # bit r: there is a bin with residual r
    residual: list[int] = []
    held: list[list[int]] = []  # per bin: bitmap of sources, bitmap of groups
    spread: dict[tuple[int, int], int] = {}  # in how many bins a source or a group is
    place, conflicts = [0] * len(sizes), [False] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        own_s = 1 << sources[i] if sources[i] >= 0 else 0
        own_g = sum(1 << g for g in set(groups[i]))
        mine = [(0, sources[i])] * (sources[i] >= 0) + [(1, g) for g in set(groups[i])]
        hopeless = any(spread.get(k, 0) == len(residual) for k in mine)  # one of them is in every bin
        tightest, found = -1, -1
        rest, r = occupied >> size, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r, rest = r + step, rest >> step
            for b in reversed(bins_at[r]):
                if tightest < 0:
                    tightest = b
                if hopeless:
                    break
                if not (held[b][0] & own_s or held[b][1] & own_g):
                    found = b
                    break
            if found >= 0 or hopeless:
                break
            r, rest = r + 1, rest >> 1
        if found < 0 and tightest >= 0 and not strict:
            found, conflicts[i] = tightest, True
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            held.append([0, 0])
        else:
            row = bins_at[residual[found]]
            del row[found]
            if not row:
                occupied &= ~(1 << residual[found])
        for kind, number in mine:
            if not held[found][kind] >> number & 1:
                spread[kind, number] = spread.get((kind, number), 0) + 1
        residual[found] -= size
        held[found][0] |= own_s
        held[found][1] |= own_g
        bins_at[residual[found]][found] = None
        occupied |= 1 << residual[found]
        place[i] = found
    return place, conflicts


def _repeated(values: np.ndarray) -> np.ndarray:
    """Small numbers of the values that occur more than once, -1 for the others."""
    codes, _ = pd.factorize(values)
    many = np.bincount(codes, minlength=1)[codes] > 1
    out = np.full(len(codes), -1)
    out[many] = pd.factorize(codes[many])[0]
    return out


def _groups(hashes: pd.Series) -> list[tuple[int, ...]]:
    """Per item the numbers of its clusters that hold another item of the shard too."""
    if not len(hashes):
        return []
    columns, first = [], 0
    for values in np.stack(hashes.to_numpy()).T:
        codes = _repeated(values)
        columns.append(np.where(codes >= 0, codes + first, -1))
        first += int(codes.max()) + 1
    return [tuple(int(c) for c in row if c >= 0) for row in np.stack(columns).T]


def pack(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str | None = "source", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, strict: bool = False, shard: int = SHARD) -> DataFrame:
    """doc_id, part, tokens, first_token, container, conflict: every row with text, whole unless larger than capacity.

    part is 0 for a whole text and 1, 2, ... for the stretches of one that had to be cut, which begin at first_token.
    Two near-duplicates, or two texts of one ``source`` (None: sources don't matter), share a container only where no other
    has room (conflict). Rows with a null text or identifier are left out, an empty text has size 0, a null source conflicts
    with nothing; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    origin = F.col(source) if source else F.lit(None).cast("string")
    rows = df.filter(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"), origin.alias("source"))
    shards = max(1, -(-rows.count() // shard))
    sized = rows.select("doc_id", "source", clusters(F.col("text")).alias("same"), token_counter(tokenizer)(F.col("text")).alias("n"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(shards)).alias("shard"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rest = group["n"].where(group["n"] <= capacity, group["n"] % capacity)
        place, conflict = best_fit(rest.tolist(), pd.factorize(group["source"])[0].tolist(), _groups(group["same"]), capacity, strict)
        out, following = [], max(place, default=-1) + 1
        for doc, n, b, c in zip(group["doc_id"], group["n"], place, conflict, strict=True):
            if n <= capacity:
                out.append((doc, 0, n, 0, b, c))
                continue
            full, left = divmod(n, capacity)
            for k in range(full):
                out.append((doc, k + 1, capacity, k * capacity, following, False))
                following += 1
            if left:
                out.append((doc, full + 1, left, full * capacity, b, c))
        return pd.DataFrame(out, columns=["doc_id", "part", "tokens", "first_token", "bin", "conflict"]).assign(shard=group["shard"].iloc[0])

    binned = sized.groupBy("shard").applyInPandas(packed, PACKED + ", shard bigint")
    return binned.select("doc_id", "part", "tokens", "first_token", (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("container"), "conflict")
