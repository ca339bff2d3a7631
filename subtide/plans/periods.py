"""Queries on the periods that rows of an episode cover, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators.periods import periods_and_gaps
from subtide.sources import tables

MIN_GAP_MS = 2000


def _all(spark: SparkSession, folder: str) -> DataFrame:
    seg = tables.segments(spark, folder, "series", "episode", "start_ms", "end_ms").select(F.lit("segments").alias("src"), "series", "episode", "start_ms", "end_ms", F.col("seg_id").alias("row_id"))
    cue = tables.cues(spark, folder, "series", "episode", "start_ms", "end_ms").select(F.lit("cues").alias("src"), "series", "episode", "start_ms", "end_ms", F.col("cue_id").alias("row_id"))
    return periods_and_gaps(seg.unionByName(cue), ["src", "series", "episode"], tie="row_id")


def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Every period and every gap."""
    return _all(spark, folder).select("src", "series", "episode", "kind", "start_ms", "end_ms", "n_rows")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods in which rows share time, and gaps of at least MIN_GAP_MS."""
    rows = _all(spark, folder).filter(((F.col("kind") == "period") & F.col("shared")) | ((F.col("kind") == "gap") & (F.col("end_ms") - F.col("start_ms") >= MIN_GAP_MS)))
    return rows.select("src", "series", "episode", "kind", "start_ms", "end_ms")


LATEST = """
seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) AS rn FROM segments) WHERE rn = 1),
cue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY ingested_at DESC) AS rn FROM cues) WHERE rn = 1)"""

_PERIODS = f"""WITH {LATEST},
rows AS (
  SELECT 'segments' AS src, series, episode, start_ms AS s, end_ms AS t FROM seg WHERE end_ms > start_ms
  UNION ALL SELECT 'cues', series, episode, start_ms, end_ms FROM cue WHERE end_ms > start_ms),
marked AS (
  SELECT *, max(t) OVER (PARTITION BY src, series, episode ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rows),
labelled AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY src, series, episode ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (
  SELECT src, series, episode, island, min(s) AS start_ms, max(t) AS end_ms, count(*) AS n_rows, bool_or(coalesce(s < before, false)) AS shared FROM labelled GROUP BY ALL),
both_kinds AS (
  SELECT src, series, episode, 'period' AS kind, start_ms, end_ms, n_rows, shared FROM periods
  UNION ALL SELECT src, series, episode, 'gap', before, s, 0, false FROM marked WHERE s > before)
"""

SQL = {
    "p1_periods": _PERIODS + "SELECT src, series, episode, kind, start_ms, end_ms, CAST(n_rows AS BIGINT) AS n_rows FROM both_kinds",
    "p1_found": _PERIODS + f"SELECT src, series, episode, kind, start_ms, end_ms FROM both_kinds WHERE (kind = 'period' AND shared) OR (kind = 'gap' AND end_ms - start_ms >= {MIN_GAP_MS})",
}
QUERIES = {"p1_periods": p1_periods, "p1_found": p1_found}
