import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from subtide.llm import lookalike, pieces

SAME = [
    ("HP35赤澜灵令", "ＨＰ３５赤澜灵令"), ("EXP听汐星谷", "ЕХР听汐星谷"), ("EXP听汐", "ЕXP听汐"), ("Mèng归归", "Mèng归归"), ("碧丹", "碧​丹﻿"), ("Lǚ Tempo 归", "Lǚ　Tempо 归"), ("明夜岚谷", "明夜岚⾕"), ("绛境", "隸境".replace("隸", "绛")), ("来了！", "来了!"),
    ("Νaïve", "Naïve"), ("ραιυ", "paiu"), ("сᎪꓔ", "cAT"), ("Υún", "Yún"), ("一二", "⼀⼆"), ("口令", "ロ令"), ("ﬁre", "fire"), ("привет", "пpивeт"),
]
DIFFERENT = [("EXP", "exp"), ("赤澜", "赤阑"), ("走吧", "走吧。"), ("a b", "ab"), ("10级", "1O级"), ("x²", "x2"), ("привет", "privet"), ("未来", "末来"), ("café", "cafe"), ("ロボット", "口ボット"), ("……", "...")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look_same_form(a, b):
    assert lookalike.consistent(a) == lookalike.consistent(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look_different_form(a, b):
    assert lookalike.consistent(a) != lookalike.consistent(b)


def test_forms_are_stable_and_the_short_way_equals_the_long(spark):
    texts = [t for pair in SAME + DIFFERENT for t in pair] + [None, "", " ", "他说：“走吧，别回头！”", "Ａ－Ｚ～　x"]
    for t in texts:
        if t is not None:
            assert lookalike.consistent(lookalike.consistent(t)) == lookalike.consistent(t)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(lookalike.consistent_form(F.col("t")).alias("f")).collect()] == [None if t is None else lookalike.consistent(t) for t in texts]
    assert lookalike.unify(df, "t").columns == ["t", "t_form"]


def test_pairs(spark):
    rows = [("a", 1, "EXP"), ("a", 2, "ЕXP"), ("a", 3, "EXP"), ("a", 4, None), ("a", 5, "。"), ("a", 6, "｡"), ("b", 7, "ЕXP"), (None, 8, "EXP"), (None, 9, "ＥXP"), ("a", 10, "")]
    df = spark.createDataFrame([(*r, "form", "e0") for r in rows], "series string, id bigint, text string, form string, e0 string")
    got = sorted((r.series, r.id_a, r.id_b) for r in lookalike.lookalike_pairs(df, ["series"], "id", "text").collect() if r.series)
    assert got == [("a", 1, 2), ("a", 2, 3)]
    brute = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] and b[2] and a[2] != b[2] and lookalike.consistent(a[2]) == lookalike.consistent(b[2]) and any(c.isalnum() for c in a[2])}
    assert {(r.id_a, r.id_b) for r in lookalike.lookalike_pairs(df, ["series"], "id", "text").collect()} == brute
    assert lookalike.lookalike_pairs(df.limit(0), ["series"], "id", "text").count() == 0


def test_classes_and_a_class_that_is_spread(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "CLASS_PART", 7)
    rows = [("a", i, ["EXP", "ЕXP", "ＥXP"][i % 3]) for i in range(60)] + [("a", 90, "apart"), ("b", 91, "EXP"), (None, 92, "EXP"), (None, 93, "EХP")]
    df = spark.createDataFrame([(*r, "form", 1) for r in rows], "series string, id bigint, text string, form string, rows int")
    got = {r.id: (r.series, r.rows, r.spellings, r.links) for r in lookalike.lookalike_classes(df, ["series"], "id", "text").collect()}
    assert got == {i: ("a", 60, 3, 40) for i in range(60)} | {i: (None, 2, 2, 1) for i in (92, 93)}
    pairs = [(r.id_a, r.id_b) for r in lookalike.lookalike_pairs(df, ["series"], "id", "text").collect()]
    assert len(pairs) == len(set(pairs)) == 60 * 40 // 2 + 1
    assert lookalike.lookalike_classes(df.limit(0), ["series"], "id", "text").count() == 0


def check(body, parts, limit=84):
    assert [p.no for p in parts] == list(range(1, len(parts) + 1))
    covered = 0
    for i, p in enumerate(parts):
        assert len(p.text) <= limit and p.text == body[p.start : p.end].strip(" ")
        assert p.start <= covered and p.end > covered  # nothing is left out, every piece brings something new
        if i:
            before = parts[i - 1]
            shared = body[p.start : before.end].strip(" ")
            words = before.text.split(" ")
            assert shared and before.text.endswith(shared)
            two = " ".join(words[-2:])
            assert shared == two or len(shared) <= 8
        covered = max(covered, p.end)
        while covered < len(body) and body[covered] == " ":
            covered += 1
    assert covered == len(body)


def test_pieces(spark):
    r = random.Random(2)
    texts = ["Hello.", None, "", "  \n ", "x" * 300, "走吧，别回头！" * 40, "a " * 200, "word " + "y" * 200 + " end of it. " + "z " * 50]
    texts += [" ".join("w" * r.randrange(1, r.choice([5, 12, 60])) + r.choice(["", "", ",", ".", "!"]) for _ in range(r.randrange(5, 120))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "i int, text string, p string")
    rows = df.select("i", pieces.normal(F.col("text")).alias("b")).select("i", "b", pieces.split(F.col("b")).alias("p")).collect()
    for row in rows:
        if row.b is None:
            assert row.p is None
        elif not row.b:
            assert row.p == []
        else:
            check(row.b, row.p)
    got = {x.i for x in pieces.split_rows(df, ["i"], "text").collect()}
    assert got == {i for i, t in enumerate(texts) if t and len(" ".join(t.split())) > 84}
    assert pieces.split_rows(df.limit(0), ["i"], "text").count() == 0


def test_cuts_fall_at_natural_boundaries(spark):
    text = "The elder will never forgive the one who took the key from the hall. " * 3
    parts = spark.range(1).select(pieces.split(pieces.normal(F.lit(text))).alias("p")).first().p
    assert all(p.text.endswith("hall.") for p in parts)
    dense = "Go on then and wait for me " * 12
    parts = spark.range(1).select(pieces.split(pieces.normal(F.lit(dense))).alias("p")).first().p
    words = set(dense.split())
    assert all(set(p.text.split()) <= words for p in parts)


def test_very_long_text(spark):
    text = "every word of this very long text counts, " * 2500
    parts = spark.range(1).select(pieces.split(pieces.normal(F.lit(text))).alias("p")).first().p
    check(" ".join(text.split()), parts)


def test_words_stay_whole_where_they_fit(spark):
    words = ["a" * 60, "short", "b" * 70, "and", "c" * 75, "end"] * 4
    parts = spark.range(1).select(pieces.split(pieces.normal(F.lit(" ".join(words)))).alias("p")).first().p
    check(" ".join(words), parts)
    assert all(p.text.split(" ")[-1] in words for p in parts)


FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
def test_every_piece_of_the_smallest_table_is_valid(spark):
    for table, ident, column in (("segments", "seg_id", "en"), ("cues", "cue_id", "text")):
        df = spark.read.parquet(f"{FOLDER}/{table}.parquet").filter(F.length(column) > 84).select(ident, pieces.normal(F.col(column)).alias("b"))
        for row in df.select("b", pieces.split(F.col("b")).alias("p")).collect():
            check(row.b, row.p)
