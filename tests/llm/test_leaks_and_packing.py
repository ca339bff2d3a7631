import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.llm import leaks, packing

DOC = "doc_id bigint, text string, source string, item_id bigint, spans string"


def test_index_counts_and_locates_like_a_scan():
    r = np.random.default_rng(0)
    seq = r.integers(1, 7, 800)
    seq[-1] = leaks.SEPARATOR
    index = leaks.Index(seq, 3)
    phrases = np.array([[a, b, c] for a in range(2, 7) for b in range(2, 7) for c in range(2, 7)])
    low, high = index.search(phrases)
    for p, a, z in zip(phrases, low, high, strict=True):
        where = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert z - a == len(where)
        assert sorted(index.locate(np.arange(a, z)).tolist()) == where


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_length():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(2, 9) for _ in range(r.randrange(1, 40))] for _ in range(2))
        assert leaks.common_length(np.array(a), np.array(b)) == lcs(a, b)


def test_leaks(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = [a + b for a in ("ka", "mo", "ri", "tel", "su") for b in ("lan", "dor", "vim", "pas", "gru", "hek")]
    en = " ".join(r.choice(vocabulary) for _ in range(60))
    zh = "".join(chr(0x4E00 + r.randrange(400)) for _ in range(100))
    w = en.split()
    noise = " ".join(f"filler{i}" for i in range(300))
    swapped = " ".join("xx" if i % 5 == 0 else x for i, x in enumerate(w))
    spread = f"{' '.join(w[:30])}\n1\n00:00:01 --> 00:00:02\n{noise}\n{' '.join(w[30:55])}"
    docs = [
        (1, f"{noise} {en.upper()} {noise}", True), (2, noise + " " + ", ".join(w[10:22]), True), (3, " ".join(w[10:21]) + " " + noise, False), (4, f"{noise}\n{swapped}", True), (5, spread, True), (6, zh[:30], True), (7, zh[5:28], False),
        (8, "".join(c if i % 6 else "囧" for i, c in enumerate(zh)), True), (9, "​".join(zh[:30]), True), (10, "\n".join(zh[i : i + 7] for i in range(0, 100, 7)), True), (11, None, False), (12, "", False), (13, en, True), (14, en, True), (15, " ".join(sorted(w)), False),
    ]
    df = spark.createDataFrame([(i, t, "s", 0, "x") for i, t, _ in docs], DOC)
    items = spark.createDataFrame([(1, "en", en), (2, "zh", zh), (3, "en", None), (4, "en", "too short")], "item_id bigint, lang string, text string")
    for words in (50, 400_000):
        found = leaks.leaked(df, items, shard_words=words)
        assert {(x.item_id, x.doc_id) for x in found.collect()} == {(2 if i in (6, 8, 9, 10) else 1, i) for i, _, hit in docs if hit}
    with monkeypatch.context() as m:
        m.setattr(leaks, "PORTION", 10)
        ids, texts = zip(*[(i, leaks.words_of(t)) for i, t, _ in docs if t], strict=True)
        query = leaks.Items([(1, "en", en), (2, "zh", zh), (4, "en", "too short")])
        assert {x[:2] for x in leaks.search_shard(list(ids), list(texts), query)} == {(x.item_id, x.doc_id) for x in found.collect()}
    assert {(x.item_id, x.doc_id) for x in leaks.leaked(df, items, block_chars=1).collect()} == {(x.item_id, x.doc_id) for x in found.collect()}
    spans = {(x.doc_id, x.first, x.last) for x in leaks.removal_spans(found).collect()}
    assert (13, 0, 59) in spans and (2, 300, 311) in spans
    assert leaks.leaked(df.limit(0), items).count() == 0 and leaks.leaked(df, items.limit(0)).count() == 0


FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
def test_runs_of_the_smallest_table_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "eval_items"))
    grams = {}
    for x in items.collect():
        words = leaks.words_of(x.text)
        n = 24 if x.lang == "zh" else 12
        for a in range(len(words) - n + 1):
            grams.setdefault(tuple(words[a : a + n]), set()).add(x.item_id)
    brute = set()
    for x in docs.filter("text is not null").collect():
        words = leaks.words_of(x.text)
        brute |= {(i, x.doc_id) for n in (12, 24) for a in range(len(words) - n + 1) for i in grams.get(tuple(words[a : a + n]), ())}
    found = leaks.leaked(docs, items).collect()
    assert {(x.item_id, x.doc_id) for x in found if x.rule == "run"} == brute


def test_best_fit_takes_the_tightest_compatible_bin():
    place, conflict = packing.best_fit([6, 5, 4, 3, 2], [-1] * 5, [()] * 5, 10)
    assert place[2] == place[0] and place[3] == place[1] and place[4] == place[1] and not any(conflict)
    place, conflict = packing.best_fit([6, 6, 4, 4], [-1] * 4, [(0, 2), (1,), (0,), (1,)], 10)
    assert place[2] == place[1] and place[3] == place[0] and not any(conflict)
    place, conflict = packing.best_fit([5, 5], [0, 0], [(), ()], 10)
    assert place == [0, 0] and conflict == [False, True]
    assert packing.best_fit([5, 5], [0, 0], [(), ()], 10, strict=True) == ([0, 1], [False, False])


@pytest.mark.skipif(not Path(packing.TOKENIZER).exists(), reason="needs a tokenizer file")
def test_containers(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice(["gate", "moon", "sword", "旧城"]) for _ in range(r.randrange(1, 600))) for _ in range(300)] + ["long " * 9000, "", None, "<|endoftext|>", "same " * 50] + ["same " * 50] * 5
    df = spark.createDataFrame([(i, t, "s", 0, "x") for i, t in enumerate(texts)], DOC)
    rows = packing.pack(df, shard=100).collect()
    assert {x.doc_id for x in rows} == {i for i, t in enumerate(texts) if t is not None}
    assert len({(x.doc_id, x.part) for x in rows}) == len(rows)
    load = {}
    for x in rows:
        load[x.container] = load.get(x.container, 0) + x.tokens
    assert max(load.values()) <= packing.CAPACITY
    total = sum(load.values())
    assert len(load) <= total / packing.CAPACITY * 1.02 + 4  # four shards
    cut = sorted((x.part, x.tokens, x.first_token) for x in rows if x.doc_id == 300)
    assert [c[0] for c in cut] == list(range(1, len(cut) + 1)) and all(c[1] == packing.CAPACITY for c in cut[:-1]) and all(c[2] == (c[0] - 1) * packing.CAPACITY for c in cut)
    assert all(x.part == 0 for x in rows if x.doc_id != 300)
    assert packing.pack(df.limit(0)).count() == 0
    apart = packing.pack(df.filter("doc_id >= 304"), source=None, strict=True).collect()
    assert len({x.container for x in apart}) == 6


def similarity(a, b):
    runs = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    return len(runs(a) & runs(b)) / len(runs(a) | runs(b))


def test_near_duplicates_share_a_cluster(spark):
    r = random.Random(5)
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(10_000)}" for _ in range(r.randrange(80, 200))]
        other = list(words)
        for _ in range(i % 3):
            other[r.randrange(len(other))] = "changed"
        rows.append((i, " ".join(words), " ".join(other).upper() + "!"))
    rows.append((999, "short text", "Short, text"))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = df.select("i", packing.clusters(F.col("a")).alias("a"), packing.clusters(F.col("b")).alias("b")).collect()
    shared = {x.i: len(set(x.a) & set(x.b)) for x in got}
    assert all(len(x.a) == packing.HASHES for x in got) and shared[999] == packing.HASHES
    near = [i for i, a, b in rows[:-1] if similarity(a, b.lower().rstrip("!")) >= 0.8]
    assert len(near) > 60 and sum(shared[i] > 0 for i in near) >= len(near) - 1
    assert not set(got[0].a) & set(got[1].a)


def test_many_copies_and_one_source_are_packed_in_time():
    n = 6000
    place, conflict = packing.best_fit([100] * n, [0] * n, [(0, 1)] * n, 2048)
    assert len(set(place)) == -(-n // 20) and sum(conflict) == n - len(set(place))


def test_share_counts_kept_words_away_from_phrases(spark):
    """A quarter is replaced so that one phrase of three is left; the other kept words stand in ones and twos."""
    items, docs = [], []
    for i, n in enumerate((40, 60, 80, 120)):
        words = [f"w{i}x{k}" for k in range(n)]
        gone = set(range(5, n, 3)[: n // 4]) if n > 60 else set(range(3, n, 4))
        text = [f"q{k}" if k in gone else w for k, w in enumerate(words)]
        items.append((i, "en", " ".join(words)))
        filler = " ".join(f"f{k}" for k in range(400))
        docs += [(2 * i, f"{filler} {' '.join(text)} {filler}"), (2 * i + 1, f"{' '.join(text[: n // 2])} {filler} {' '.join(text[n // 2 :])}")]
    pool = [f"v{k}" for k in range(60)]
    kept = [w if k % 3 else "zz" for k, w in enumerate(pool)]  # a third replaced: under the share
    items.append((9, "en", " ".join(pool)))
    docs.append((99, " ".join(pool[:3] + kept[3:])))
    df = spark.createDataFrame([(d, t, "s", 0, "x") for d, t in docs], DOC)
    found = leaks.leaked(df, spark.createDataFrame(items, "item_id bigint, lang string, text string")).collect()
    expected = {(i, d) for i, _, item in items for d, t in docs if lcs(item.split(), t.split()) >= 0.75 * len(item.split())}
    assert len(expected) == 8 and {(x.item_id, x.doc_id) for x in found} == expected
    text, item = dict(docs), {i: t for i, _, t in items}
    for x in found:
        assert x.share == lcs(item[x.item_id].split(), text[x.doc_id].split()) / len(item[x.item_id].split())


def test_every_second_word_after_a_passage_counts(spark):
    """The first eleven words, one replaced, and then every second word: three quarters of the item, mostly without a phrase."""
    w = [f"w{k}" for k in range(24)]
    kept = w[:11] + ["zz"] + [x if k % 2 else "zz" for k, x in enumerate(w[12:])]
    text = " ".join(kept + ["f"] * 50)
    share = lcs(w, text.split()) / 24
    df = spark.createDataFrame([(1, text, "s", 0, "x"), (2, " ".join(w[:11] + ["zz"] * 3 + w[14:22:1] + ["zz"] * 2), "s", 0, "x")], DOC)
    items = spark.createDataFrame([(1, "en", " ".join(w))], "item_id bigint, lang string, text string")
    expected = {d for d, t in ((1, text), (2, " ".join(w[:11] + ["zz"] * 3 + w[14:22] + ["zz"] * 2))) if lcs(w, t.split()) >= 18}
    assert {x.doc_id for x in leaks.leaked(df, items).collect()} == expected and (share >= 0.75) == (1 in expected)
