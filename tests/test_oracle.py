"""Every core query that SQL can express, against DuckDB on the smallest tables."""

import json
import math
from pathlib import Path

import duckdb
import pandas
import pytest

from subtide.plans import catalogue
from subtide.plans.periods import LATEST

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(frame):
    def value(v):
        if v is None or v is pandas.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "item") else repr(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted([tuple(value(v) for v in row) for row in frame.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, str(FOLDER)).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_other_query_is_tested_here():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"store_export", "condense_outcomes"}


def test_store_export_holds_every_row(spark, duck):
    """JSON as text differs between engines; its rows don't."""
    got = {}
    for r in catalogue.queries()["store_export"](spark, str(FOLDER)).collect():
        for item in json.loads(r.rows):
            got.setdefault(r.kind, []).append((r.series, item["source"], item.get("en", item.get("alternative")), item.get("n")))
    terms = duck.execute("SELECT series, source, en, NULL FROM terms").fetchall()
    candidates = duck.execute(f"SELECT series, source, en, n FROM ({catalogue.oracle_sql()['candidate_counts']})").fetchall()
    conflicts = duck.execute(f"SELECT series, source, alternative, NULL FROM ({catalogue.oracle_sql()['term_conflicts']})").fetchall()
    for kind, rows in (("terms", terms), ("candidates", candidates), ("conflicts", conflicts)):
        assert sorted(got.get(kind, []), key=repr) == sorted(rows, key=repr)


def test_condensation_counts_add_up(spark, duck):
    """What SQL can tell of the counters: the targets, the texts that lose a term, and how they add up."""
    rows = catalogue.queries()["condense_outcomes"](spark, str(FOLDER)).collect()
    severe = catalogue.oracle_sql()["severe_sources"]
    targets = duck.execute(f"WITH {LATEST}, v AS ({severe}) SELECT v.series, v.episode, count(*) FROM v JOIN seg ON v.series = seg.series AND v.episode = seg.episode AND v.source_id = seg.id WHERE en IS NOT NULL AND text_zh IS NOT NULL GROUP BY ALL").fetchall()
    assert rows and {(r.series, r.episode): r.targeted for r in rows} == {(s, e): n for s, e, n in targets}
    for r in rows:
        assert r.targeted == r.accepted + r.no_improvement + r.terminology + r.semantic_risk + r.cache_hit
        assert (r.cache_hit, r.generation, r.cache_miss) == (0, r.targeted, r.targeted)
        assert r.accepted <= r.verification + r.verification_avoided <= r.targeted - r.terminology
    assert sum(r.accepted for r in rows) > 0 and sum(r.semantic_risk for r in rows) <= sum(r.verification for r in rows)
