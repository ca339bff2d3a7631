import random

import pytest

from subtide.operators import ordered, timeline
from subtide.operators.periods import combine, periods_and_gaps

SCHEMA = "series string, episode string, start_ms bigint, end_ms bigint, row_id bigint, e string, s bigint, kind string"


def brute(rows):
    out = []
    for key in {r[:2] for r in rows}:
        mine = sorted((r[2], r[3]) for r in rows if r[:2] == key and None not in r[2:4] and r[3] > r[2])
        periods = []
        for s, t in mine:
            if periods and s <= periods[-1][1]:
                last = periods[-1]
                last[3] = last[3] or s < last[1]
                last[1] = max(last[1], t)
                last[2] += 1
            else:
                if periods:
                    out.append((*key, "gap", periods[-1][1], s, 0, False))
                periods.append([s, t, 1, False])
        out += [(*key, "period", p[0], p[1], p[2], p[3]) for p in periods]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(600):  # one entity holds most of the rows, so it spans partitions
        key = ("hot", "1") if r.random() < 0.7 else (r.choice(["a", None]), r.choice(["1", "2", None]))
        s = r.choice([None, r.randrange(0, 6000)]) if r.random() < 0.1 else r.randrange(0, 6000)
        t = None if r.random() < 0.05 else (s or 0) + r.randrange(-3, 12 if r.random() < 0.95 else 900)
        rows.append((*key, s, t, i))
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame([(*x, "x", 1, "y") for x in rows], SCHEMA)
    got = periods_and_gaps(df, ["series", "episode"], tie="row_id", partitions=7)
    assert sorted([tuple(x) for x in got.collect()], key=repr) == brute(rows)


def test_empty_and_one_long_cover(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), ["series", "episode"]).count() == 0
    rows = [("a", "1", 0, 10_000, 0)] + [("a", "1", i * 10, i * 10 + 5, i) for i in range(1, 300)]
    got = periods_and_gaps(spark.createDataFrame([(*x, "x", 1, "y") for x in rows], SCHEMA), ["series", "episode"], partitions=9).collect()
    assert [tuple(x)[2:] for x in got] == [("period", 0, 10_000, 300, True)]


def test_combine_carries_through_partitions_of_one_entity():
    part = lambda pid, first, last, most, start, single: dict(pid=pid, first_e=first, last_e=last, tail_max=most, tail_start=start, single=single)
    carried = combine([part(0, "a", "b", 100, 1, False), part(1, "b", "b", 50, 40, True), part(3, "b", "c", 7, 6, False)])
    assert carried == {1: ("b", 100, 1), 3: ("b", 100, 1)}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_neighbours_across_blocks(spark, block):
    rows = [("k", i, i * i) for i in range(0, 20, 2)] + [(None, 5, 1), ("z", 1, 2), ("z", 1, 3)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(x.k, x.o, x.v): (x.before.v if x.before else None, x.after.v if x.after else None, x.position) for x in ordered.plain(ordered.neighbours(df, ["k"], ["o", "v"], ["v"], block)).collect()}
    for key in ("k", None, "z"):
        mine = sorted(r for r in rows if r[0] == key)
        for i, r in enumerate(mine):
            assert got[r] == (mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None, i + 1)


def test_subtraction_per_interval_and_across_blocks(spark):
    a = spark.createDataFrame([("x", 1, 0, 100), ("x", 2, 50, 150), ("y", 3, 0, 10)], "k string, id bigint, start_ms bigint, end_ms bigint")
    b = spark.createDataFrame([("x", 20, 30), ("x", 25, 60), ("x", 140, 400), ("y", 0, 10)], "k string, start_ms bigint, end_ms bigint")
    for block in (7, 64, 10_000):
        got = sorted(tuple(r) for r in timeline.subtract_intervals(a, b, ["k"], "id", 5, block).collect())
        assert got == [("x", 1, 0, 20), ("x", 1, 60, 100), ("x", 2, 60, 140)]


def test_uncovered_window_is_padded_and_joined(spark):
    speech = spark.createDataFrame([("s", "1", 10000, 12100), ("s", "1", 13000, 13800), ("s", "1", 15400, 18000)], "series string, episode string, start_ms bigint, end_ms bigint")
    seg = spark.createDataFrame([("s", "1", 10000, 12100), ("s", "1", 15400, 18000)], speech.schema)
    assert [tuple(r) for r in timeline.uncovered_windows(speech, seg, ["series", "episode"]).collect()] == [("s", "1", 12600, 14200)]
    assert timeline.uncovered_windows(speech.limit(0), seg, ["series", "episode"]).count() == 0


def test_range_neighbours_reports_each_pair_once(spark):
    w = spark.createDataFrame([("k", 0, 200_000)], "k string, start_ms bigint, end_ms bigint")
    r = spark.createDataFrame([("k", 1, 10, 190_000), ("k", 2, 201_999, 300_000), ("k", 3, 202_000, 203_000), ("j", 4, 0, 5)], "k string, id bigint, start_ms bigint, end_ms bigint")
    assert sorted(x.row_id for x in timeline.range_neighbours(w, r, ["k"]).collect()) == [1, 2]
