"""One entity that holds every row: sequences are cut into blocks and stretches, and the result is that of a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from subtide.operators import folds, ordered, timeline
from subtide.sources import files, sinks

KEYS = ["series", "episode"]
WORDS = "array<struct<start_ms:bigint,end_ms:bigint,word:string>>"


@pytest.mark.parametrize("block", [1, 16, 4096])
def test_neighbours_with_null_orders(spark, block):
    r = random.Random(block)
    rows = [("s", None, None if r.random() < 0.4 else r.randrange(300), i) for i in range(500)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "series string, episode string, o int, id bigint, label string")
    near = ordered.neighbours(df, KEYS, ["o", "id"], ["id"], block)
    got = {x.id: (x.before and x.before.id, x.after and x.after.id, x.position) for x in near.collect()}
    line = [x[3] for x in sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[3]))]
    assert got == {i: (line[k - 1] if k else None, line[k + 1] if k + 1 < len(line) else None, k + 1) for k, i in enumerate(line)}
    marks = {x.id: x.at for x in ordered.labels(near, ["o", "id"], F.col("id") % 7 == 0, "at").collect()}
    last, expected = None, {}
    for k, i in enumerate(line):
        last = k + 1 if i % 7 == 0 else last
        expected[i] = last
    assert marks == expected


def test_cleanup_of_one_endless_sentence(spark):
    r = random.Random(4)
    rows, at = [], 0
    for i in range(2000):
        at += r.choice([0, 0, 50, 120, 160, -200])
        end = at + r.choice([100, 300, 900])
        rows.append(("s", "1", i, max(0, at), max(1, end), r.choice(["来，", "走，", "快走，", "别动，有人来了，", "停"]), [(max(0, at), max(1, end), "字")] if r.random() < 0.5 else None))
        at = end
    df = spark.createDataFrame(rows, f"series string, episode string, pos int, start_ms bigint, end_ms bigint, text_zh string, words {WORDS}")
    state, expected = folds.CleanupState(), []
    for _, _, _, start, end, text, words in rows:
        what = state.step("s", start, end, text)
        if what == state.KEPT:
            expected.append([start, end, text, list(words or [])])
        else:
            expected[-1][1] = state.end
            if what == state.CONTINUES:
                expected[-1][2] += text
                expected[-1][3] += words or []
    expected = [(w[0][0] if w else s, w[-1][1] if w else e, t) for s, e, t, w in expected]
    got = folds.cleanup(df).orderBy("id").collect()
    assert [(x.start_ms, x.end_ms, x.text_zh) for x in got] == expected and [x.id for x in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize(("seed", "least"), [(0, 1), (1, 5), (2, 20)])
def test_subtraction_against_single_points(spark, seed, least):
    r = random.Random(seed)
    span = lambda n: [("s", None if r.random() < 0.1 else "1", s := r.randrange(300), s + r.randrange(-2, 60), i) for i in range(n)]
    own, cover = span(60), span(25) + [("s", "2", 0, 10, 99)]
    own += [("t", "1", 5, 40, 900), ("s", "1", None, 4, 901)]
    schema = "series string, episode string, start_ms bigint, end_ms bigint, id bigint"
    got = timeline.subtract_intervals(spark.createDataFrame(own, schema), spark.createDataFrame(cover, schema), KEYS, "id", least, block=50, tie="id")
    expected = []
    for series, episode, s, e, i in own:
        if s is None or e - s < least:
            continue
        free = [p for p in range(s, e) if not any(c[:2] == (series, episode) and c[2] <= p < c[3] for c in cover)]
        begins = [p for p in free if p - 1 not in free]
        for b in begins:
            z = b
            while z in free:
                z += 1
            if z - b >= least:
                expected.append((i, b, z))
    assert sorted((x.id, x.start_ms, x.end_ms) for x in got.collect()) == sorted(expected)


def test_an_srt_text_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_CUES", 7)
    cues = spark.createDataFrame([("s", "1", i, i * 1000, i * 1000 + 900, f"Cue {i}" if i % 5 else " ") for i in range(100)], "series string, episode string, id int, start_ms bigint, end_ms bigint, text string")
    assert sinks.srt_texts(cues, KEYS, "id").count() == 12
    sinks.write_srt(cues, str(tmp_path), KEYS, "id")
    (path,) = tmp_path.rglob("*.txt")
    whole = spark.createDataFrame([(path.read_text(),)], "text string")
    back = files.parse_srt(whole, [], strict=True).orderBy("n").collect()
    assert [x.text for x in back] == [f"Cue {i}" for i in range(100) if i % 5] and [x.id for x in back] == list(range(1, 81))
