"""The words of one segment, array<struct<start_ms, end_ms, word>>, as row expressions: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subtide.config import DEFAULT, EngineConfig
from subtide.functions.columns import let

_EMPTY = "array<struct<start_ms:bigint,end_ms:bigint,word:string>>"


def present(words: Column) -> Column:
    """Never null, and without null words."""
    return F.filter(F.coalesce(words, F.array().cast(_EMPTY)), lambda w: w.isNotNull() & w["start_ms"].isNotNull() & w["end_ms"].isNotNull())


def gaps(words: Column) -> Column:
    """Silence before each word but the first; a word's own predecessor counts, not the latest end so far."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 2, F.greatest(n - 1, F.lit(0))), F.slice(words, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b["start_ms"] - a["end_ms"])).otherwise(F.array().cast("array<bigint>"))


def island_count(words: Column, limit_ms: int) -> Column:
    """Stretches of words separated by more than ``limit_ms``; 0 without words."""
    return F.when(F.size(words) == 0, 0).otherwise(1 + F.size(F.filter(gaps(words), lambda g: g > limit_ms)))


def islands(words: Column, limit_ms: int) -> Column:
    """array<struct<start_ms, end_ms, n>> of the stretches, in order."""

    def cut(words: Column, gaps_: Column) -> Column:
        n = F.size(words)
        firsts = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.get(gaps_, i - 1) > limit_ms)))

        def one(firsts_: Column) -> Column:
            def stretch(i: Column) -> Column:
                a = F.get(firsts_, i)
                z = F.coalesce(F.get(firsts_, i + 1), n)
                return F.struct(F.get(words, a)["start_ms"].alias("start_ms"), F.get(words, z - 1)["end_ms"].alias("end_ms"), (z - a).alias("n"))

            return F.transform(F.sequence(F.lit(0), F.size(firsts_) - 1), stretch)

        return F.when(n > 0, let(firsts, one)).otherwise(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,n:int>>"))

    return let(words, lambda w: let(gaps(w), lambda g: cut(w, g)))


def dominant(islands_: Column) -> Column:
    """The island with most words, the earliest among equals, as struct<start_ms, end_ms, n>."""
    best = F.array_min(F.transform(islands_, lambda i: F.struct((-i["n"]).alias("m"), i["start_ms"].alias("s"), i["end_ms"].alias("e"))))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["s"].alias("start_ms"), b["e"].alias("end_ms"), (-b["m"]).alias("n"))))


def span(start: Column, end: Column, words: Column) -> Column:
    """struct<start_ms, end_ms>: from the first word's start to the last word's end, or the segment's own times."""
    return F.struct(F.coalesce(F.get(words, F.lit(0))["start_ms"], start).alias("start_ms"), F.coalesce(F.try_element_at(words, F.lit(-1))["end_ms"], end).alias("end_ms"))


def suspect_reasons(start: Column, end: Column, words: Column, config: EngineConfig = DEFAULT) -> Column:
    """struct<reasons, largest_gap_ms, islands> of a segment."""

    def of(w: Column) -> Column:
        largest = F.coalesce(F.array_max(gaps(w)), F.lit(0)).cast("bigint")
        n = island_count(w, config.audit_island_ms)
        long = let(span(start, end, w), lambda s: s["end_ms"] - s["start_ms"] > config.max_duration_ms)
        reasons = F.array_compact(F.array(
            F.when(n > 1, "multiple_speech_islands"), F.when((F.size(w) > 0) & (largest >= config.audit_island_ms), "large_internal_word_gap"), F.when(long, "long_duration"),
        ))
        return F.struct(reasons.alias("reasons"), F.greatest(largest, F.lit(0)).alias("largest_gap_ms"), n.cast("bigint").alias("islands"))

    return let(present(words), of)


def sentences(words: Column, end_pattern: str = "[。！？!?]$") -> Column:
    """array<struct<start_ms, end_ms, text, words>>: the words cut after each that ends a sentence; what is left is kept."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.trim(F.get(w, i - 1)["word"]).rlike(end_pattern) | (i == n)))

        def one(e: Column) -> Column:
            def sentence(k: Column) -> Column:
                a = F.when(k == 0, 0).otherwise(F.get(e, k - 1))
                part = F.slice(w, a + 1, F.get(e, k) - a)
                return F.struct(F.get(w, a)["start_ms"].alias("start_ms"), F.get(w, F.get(e, k) - 1)["end_ms"].alias("end_ms"), F.trim(F.array_join(F.transform(part, lambda x: x["word"]), "")).alias("text"), part.alias("words"))

            return F.when(F.size(e) > 0, F.transform(F.sequence(F.lit(0), F.size(e) - 1), sentence))

        return F.when(n > 0, let(ends, one))

    return let(words, cut)
