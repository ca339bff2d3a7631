"""Queries of the operators for training text, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import leaks, lookalike, packing, pairs, pieces, residue, runs
from subtide.llm import repetition as rep
from subtide.plans.periods import LATEST
from subtide.sources import tables


def p2_defects(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.broken_pairs(tables.table(spark, folder, "translation_memory"), "seq", "source", "en")
    return found.select("seq", F.concat_ws(",", "defects").alias("defects"), "defect")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(tables.table(spark, folder, "translation_memory"), "seq", "source", "en").select("seq", "defect")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.segments(spark, folder, "text_zh", "words")
    raised = rep.flagged(rows, "seg_id", "text_zh", "words")
    return raised.filter(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in rep.REPEATED]))).select("seg_id")


def p3_measures(spark: SparkSession, folder: str) -> DataFrame:
    return rep.repetition(tables.segments(spark, folder, "text_zh", "words"), "seg_id", "text_zh", "words")


def _runs(spark: SparkSession, folder: str, singletons: bool) -> DataFrame:
    seg = tables.segments(spark, folder, "series", "episode", "pos", "start_ms", "end_ms", "text_zh")
    cue = tables.cues(spark, folder, "series", "episode", "id", "start_ms", "end_ms", "text")
    both = seg.select(F.lit("segments").alias("src"), "series", "episode", F.col("pos").alias("at"), F.col("seg_id").alias("row_id"), "start_ms", "end_ms", F.col("text_zh").alias("text")).unionByName(
        cue.select(F.lit("cues").alias("src"), "series", "episode", F.col("id").alias("at"), F.col("cue_id").alias("row_id"), "start_ms", "end_ms", "text")
    )
    return runs.collapse_runs(both, ["src", "series", "episode"], "at", "row_id", "text", singletons=singletons)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, False).select("src", "first_id", "last_id")


def p5_events(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, True)


def _spelt(spark: SparkSession, folder: str) -> DataFrame:
    return (
        tables.table(spark, folder, "terms").select(F.lit("term").alias("kind"), "series", F.col("term_id").alias("id"), F.col("source").alias("text"))
        .unionByName(tables.table(spark, folder, "translation_memory").select(F.lit("memory").alias("kind"), "series", F.col("seq").alias("id"), F.col("source").alias("text")))
        .unionByName(tables.segments(spark, folder, "series", "text_zh").select(F.lit("segment").alias("kind"), "series", F.col("seg_id").alias("id"), F.col("text_zh").alias("text")))
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(_spelt(spark, folder), ["kind", "series"], "id", "text").select("kind", "id_a", "id_b")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_classes(_spelt(spark, folder), ["kind", "series"], "id", "text")


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.unify(tables.segments(spark, folder, "text_zh").select("seg_id", "text_zh"), "text_zh")


def _split(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.segments(spark, folder, "en").select(F.lit("segments").alias("src"), F.col("seg_id").alias("row_id"), F.col("en").alias("text")).unionByName(
        tables.cues(spark, folder, "text").select(F.lit("cues").alias("src"), F.col("cue_id").alias("row_id"), "text")
    )
    return pieces.split_rows(rows, ["src", "row_id"], "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).filter("no = 1 and n_pieces >= 2").select("src", "row_id")


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tables.table(spark, folder, "documents"))


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(tables.table(spark, folder, "documents"), tables.table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaked(spark, folder).select("item_id", "doc_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.removal_spans(_leaked(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(tables.table(spark, folder, "documents")).select("doc_id")


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    return residue.without_residue(tables.table(spark, folder, "documents")).select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_defects, p3_found, p3_measures, p4_found, p4_classes, p4_forms, p5_found, p5_events, p6_found, p6_pieces, p7_containers, p8_found, p8_spans, p9_found, p9_kept)}


def _one_apart(a: str, b: str) -> str:
    """SQL: equal and not empty, or one character inserted, removed or replaced while both have at least eight."""
    at = f"range(0, greatest(length({a}), length({b})) + 1)"
    replaced = f"length({a}) = length({b}) AND len(list_filter({at}, lambda i: left({a}, i) = left({b}, i) AND substr({a}, i + 2) = substr({b}, i + 2))) > 0"
    longer = f"length({a}) = length({b}) + 1 AND len(list_filter({at}, lambda i: left({a}, i) = left({b}, i) AND substr({a}, i + 2) = substr({b}, i + 1))) > 0"
    shorter = f"length({b}) = length({a}) + 1 AND len(list_filter({at}, lambda i: left({a}, i) = left({b}, i) AND substr({a}, i + 1) = substr({b}, i + 2))) > 0"
    return f"(({a} <> '' AND {a} = {b}) OR (length({a}) >= 8 AND length({b}) >= 8 AND (({replaced}) OR ({longer}) OR ({shorter}))))"


_PLAIN = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_SHORT = r"trim(regexp_replace({0}, '[ \t\n\r\x{{0B}}\x{{0C}}\x{{A0}}\x{{202F}}]+', ' ', 'g'))"


_RUNS = f"""WITH {LATEST},
r AS (SELECT 'segments' AS src, series, episode, pos AS o, seg_id AS id, start_ms AS s, end_ms AS e, text_zh AS tx, coalesce({_PLAIN.format("text_zh")}, '') AS p FROM seg WHERE end_ms > start_ms
  UNION ALL SELECT 'cues', series, episode, cue.id, cue_id, start_ms, end_ms, text, coalesce({_PLAIN.format("text")}, '') FROM cue WHERE end_ms > start_ms),
n AS (SELECT *, lag(e) OVER w AS pe, lag(p) OVER w AS pp FROM r WINDOW w AS (PARTITION BY src, series, episode ORDER BY o, id)),
b AS (SELECT *, coalesce(s <= pe + 3000 AND {_one_apart("p", "pp")}, false) AS goes_on FROM n),
l AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY src, series, episode ORDER BY o, id ROWS UNBOUNDED PRECEDING) AS run FROM b)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _RUNS + " SELECT src, arg_min(id, (o, id)) AS first_id, arg_max(id, (o, id)) AS last_id FROM l GROUP BY src, series, episode, run HAVING count(*) > 1",
        "p5_events": _RUNS + " SELECT src, series, episode, arg_min(id, (o, id)) AS first_id, arg_max(id, (o, id)) AS last_id, count(*) AS n, arg_min(s, (o, id)) AS start_ms, max(e) AS end_ms, max(e) - arg_min(s, (o, id)) AS duration_ms, arg_min_null(tx, (o, id)) AS text FROM l GROUP BY src, series, episode, run",
        "p6_found": f"WITH {LATEST} SELECT 'segments' AS src, seg_id AS row_id FROM seg WHERE length({_SHORT.format('en')}) > 84 UNION ALL SELECT 'cues', cue_id FROM cue WHERE length({_SHORT.format('text')}) > 84",
    }
