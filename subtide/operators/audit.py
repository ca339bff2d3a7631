"""Completeness of recognition: suspect segments, speech that no segment covers, what recovery may add, the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.config import DEFAULT, EngineConfig
from subtide.functions import text as X
from subtide.functions import words as W
from subtide.functions.columns import let
from subtide.operators import folds, timeline
from subtide.session import durable

KEYS = ["series", "episode"]


def flag_suspects(segments: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``segments`` with suspect_reasons, largest_internal_gap_ms, speech_islands and asr_suspect set anew."""
    found = W.suspect_reasons(F.col("start_ms"), F.col("end_ms"), F.col("words"), config)
    rows = segments.withColumn("__f", let(found, lambda x: x))
    out = rows.withColumns({"suspect_reasons": F.col("__f.reasons"), "largest_internal_gap_ms": F.col("__f.largest_gap_ms"), "speech_islands": F.col("__f.islands"), "asr_suspect": F.size("__f.reasons") > 0})
    return out.drop("__f")


def recovery_verdict(text: Column, neighbours: Column, max_unit: int = 3, min_repeats: int = 3) -> Column:
    """'ok', or why a recovered text is not: the first rule that applies. neighbours: array<string>."""
    bare = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s", "")
    letters = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)[\s\W_]", "")
    others = F.filter(F.transform(F.coalesce(neighbours, F.array().cast("array<string>")), bare), lambda n: n != "")
    return (
        F.when((F.trim(F.coalesce(text, F.lit(""))) == "") | (X.han(text) == 0), "empty_or_no_chinese").when(letters(text) == "", "punctuation_only")
        .when(X.han(text) * 2 < F.length(F.trim(text)), "mostly_non_chinese").when(text.rlike(rf"(.{{1,{max_unit}}})\1{{{min_repeats - 1},}}"), "repetition")
        .when(F.exists(others, lambda n: n.contains(bare(text)) | bare(text).contains(n)), "duplicate_neighbor").otherwise("ok")
    )


def recovery_windows(speech: DataFrame, segments: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The first ``max_windows`` uncovered windows of each episode, by time, with rank."""
    windows = timeline.uncovered_windows(speech, segments, KEYS, config)
    return timeline.top_k(windows, KEYS, [F.col("start_ms"), F.col("end_ms")], config.max_windows)


def audit(segments: DataFrame, speech: DataFrame, transcribe: Callable[[DataFrame], DataFrame] | None = None, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(segments, report). transcribe: windows -> the same rows with text_zh and words, null where nothing was heard.

    Rows recovered earlier are removed first, so that a second audit gives the same. Without ``transcribe`` recovery is
    off: the segments come back flagged and the report counts no windows. The report has one row per episode; which segments
    are suspect is in their rows (``suspects``).
    """
    original = segments.filter(~F.coalesce("recovered", F.lit(False)))
    flagged = flag_suspects(original, config)
    base = flagged.groupBy(*KEYS).agg(
        F.count("*").alias("original"), F.count_if("asr_suspect").alias("suspects"), F.count_if(F.array_contains("suspect_reasons", "large_internal_word_gap")).alias("large_gaps")
    )
    zero = F.lit(0).cast("bigint")
    if transcribe is None:
        return flagged, base.select(F.lit(config.audit_version).alias("version"), F.lit(False).alias("enabled"), *KEYS, "original", zero.alias("windows"), zero.alias("recovered"), zero.alias("merged"), zero.alias("rejected"), "suspects", "large_gaps")
    # Cut after each step: the windows and what was heard are asked for several times, and a recogniser is paid once.
    windows = durable(recovery_windows(speech, original, config))
    heard = durable(transcribe(windows.select(*KEYS, "start_ms", "end_ms")).filter(F.trim(F.coalesce("text_zh", F.lit(""))) != ""))
    near = timeline.range_neighbours(heard.select(*KEYS, "start_ms", "end_ms"), original.select(*KEYS, "start_ms", "end_ms", "text_zh"), KEYS, config.neighbour_ms)
    texts = near.groupBy(*KEYS, "start_ms", "end_ms").agg(F.collect_set("row_text_zh").alias("near"))  # of one window
    judged = heard.join(texts, [*KEYS, "start_ms", "end_ms"], "left").withColumn("verdict", recovery_verdict(F.col("text_zh"), F.col("near")))
    accepted = judged.filter("verdict = 'ok'")
    merged = durable(folds.merge_recovered(original, durable(accepted)))
    out = flag_suspects(merged, config)
    counts = windows.groupBy(*KEYS).agg(F.count("*").alias("windows"))
    verdicts = judged.groupBy(*KEYS).agg(F.count_if(F.col("verdict") == "ok").alias("recovered"), F.count_if(F.col("verdict") != "ok").alias("rejected"))
    kept = merged.groupBy(*KEYS).agg(F.count_if("recovered").alias("merged"))
    report = base.join(counts, KEYS, "left").join(verdicts, KEYS, "left").join(kept, KEYS, "left")
    return out, report.select(F.lit(config.audit_version).alias("version"), F.lit(True).alias("enabled"), *KEYS, "original", *[F.coalesce(c, zero).alias(c) for c in ("windows", "recovered", "merged", "rejected")], "suspects", "large_gaps")


def suspects(segments: DataFrame) -> DataFrame:
    """series, episode, id of the flagged segments that are suspect."""
    return segments.filter("asr_suspect").select(*KEYS, F.col("id").cast("bigint").alias("id"))


def needs_audit(states: DataFrame, recovery: bool, config: EngineConfig = DEFAULT) -> DataFrame:
    """States whose audit is missing, of another version, or was made without the recovery that is now asked for."""
    a = F.col("asr_audit")
    return states.filter(a.isNull() | ~a["version"].eqNullSafe(config.audit_version) | (F.lit(recovery) & ~F.coalesce(a["enabled"], F.lit(False))))
