"""From translated segments to cues: timing, splitting, line balance, numbering, and the report on the result."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.config import DEFAULT, EngineConfig
from subtide.functions import text as X
from subtide.functions import words as W
from subtide.functions.columns import big, let
from subtide.functions.text import LINE_END_AVOID, LINE_START_GOOD, NBSP  # by name: Arrow functions are shipped by value
from subtide.operators import memory as M
from subtide.operators import ordered, timeline


def _penalty(left: str, right: str) -> int:
    bare = left.lower().strip('".,;:!?')
    if bare in LINE_END_AVOID or bare.endswith("'s"):
        return 150
    for marks, value in ((".!?", -20), (",;:", -10)):
        if left[-1:] and left[-1] in marks:
            return value
    if right.lower() in LINE_START_GOOD:
        return -8
    return 100 if left.lower() == "so" else 0


def recognition_suspect(text: Column, avg_logprob: Column, no_speech_prob: Column) -> Column:
    """A character repeated, or a recogniser that was in doubt."""
    return X.repeated_character(text) | (F.coalesce(avg_logprob, F.lit(0.0)) < -1) | (F.coalesce(no_speech_prob, F.lit(0.0)) > 0.6)


class _Lines:
    """Line balance of any stretch of one text's words, from running lengths."""

    def __init__(self, words: Sequence[str], config: EngineConfig):
        self.words, self.config = words, config
        self.ends = [0]
        for w in words:
            self.ends.append(self.ends[-1] + len(w) + 1)

    def length(self, a: int, z: int) -> int:
        return self.ends[z] - self.ends[a] - 1

    def text(self, a: int, z: int) -> str:
        return " ".join(self.words[a:z])

    def wrapped(self, a: int, z: int) -> str | None:
        limit, soft = self.config.line_limit, self.config.line_soft
        if self.length(a, z) <= limit:
            return self.text(a, z).replace(NBSP, " ")
        best: tuple | None = None
        for cut in range(a + 1, z):
            n, m = self.length(a, cut), self.length(cut, z)
            if max(n, m) > limit:
                continue
            score = abs(n - m) + (100 if min(n, m) < self.config.line_short else 0) + max(0, n - soft) + max(0, m - soft) + _penalty(self.words[cut - 1], self.words[cut])
            option = (score, self.text(a, cut), self.text(cut, z))
            best = option if best is None or option < best else best
        return None if best is None else f"{best[1]}\n{best[2]}".replace(NBSP, " ")


def split_words(words: Sequence[str], duration_ms: int, config: EngineConfig = DEFAULT) -> list[str]:
    """Parts of a text, each at most two lines: whole where it fits and is short enough, else cut where it costs least."""
    lines, n = _Lines(words, config), len(words)
    whole = lines.wrapped(0, n)
    if whole is not None and duration_ms <= config.max_duration_ms:
        return [whole]
    wanted = max(1, math.ceil(duration_ms / config.max_duration_ms), math.ceil(lines.length(0, n) / config.split_chars))
    parts: list[str] = []
    at = 0
    while at < n:
        rest = lines.length(at, n)
        target = max(config.split_target, math.ceil(rest / max(1, wanted - len(parts))))
        best: tuple | None = None
        for z in range(at + 1, n + 1):
            length = lines.length(at, z)
            if length > 2 * config.line_limit + 1:
                break
            shown = lines.wrapped(at, z)
            if shown is None:
                continue
            last = words[z - 1][-1:]
            mark = 0 if z == n or last in tuple(".?!") else 8 if last in tuple(",;:") else 16
            cost = abs(length - target) + mark + (0 if z == n else _penalty(words[z - 1], words[z]))
            best = min(best, (cost, z - at, shown)) if best is not None else (cost, z - at, shown)
        if best is None:
            best = (0, 1, words[at].replace(NBSP, " "))
        parts.append(best[2])
        at += best[1]
    return parts


def _splitter(config: EngineConfig):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(words: pd.Series, duration: pd.Series) -> pd.Series:
        return pd.Series([[] if w is None or d != d else split_words(list(w), int(d), config) for w, d in zip(words, duration, strict=True)], dtype=object)

    return split


def split_text(text: Column, duration_ms: Column, names: Column | None = None, config: EngineConfig = DEFAULT, once: bool = False) -> Column:
    """array<string>: greedy over whole words, which a loop over what is left of each text decides; hence an Arrow UDF.

    ``once`` keeps the optimiser from copying the call into expressions that use its result.
    """
    split = _splitter(config)
    return (split.asNondeterministic() if once else split)(X.layout_words(text, names), duration_ms)


def with_names(rows: DataFrame, glossary: DataFrame, text: str = "en") -> DataFrame:
    """``rows`` (with series) and names: the English of the series' glossary that stands in each text, to be kept together.
    Each distinct text is matched once; a text holds only the names that are in it, however large the glossary."""
    entries = glossary.filter("en is not null and en like '% %'").select("series", F.col("en").alias("source")).distinct()
    texts = rows.filter(F.col(text).isNotNull()).select("series", X.squeeze(F.col(text)).alias("text")).distinct()
    held = M.contained(texts, entries).groupBy("series", "text").agg(F.array_sort(F.collect_set("term")).alias("names")).withColumnsRenamed({"series": "__series", "text": "__text"})
    same = F.col("series").eqNullSafe(F.col("__series")) & (X.squeeze(F.col(text)) == F.col("__text"))
    return rows.join(held, same, "left").drop("__series", "__text")


#: Segments that take part in the layout.
SHOWN = "trim(en) <> '' and start_ms is not null and end_ms > start_ms"


def speech_times(segments: DataFrame, config: EngineConfig = DEFAULT, following: DataFrame | None = None) -> DataFrame:
    """Segments with the times at which their speech is shown: cue_start_ms, cue_end_ms, and what was done to them.

    A span that is too long is cut to its dominant island, or without words to a readable time; then both ends are
    padded and kept clear of the next segment. A segment that would end before it starts keeps no cue (``timing_error``).
    ``following``: all segments of the episodes, where ``segments`` are a selection, for the start of the next one.
    """
    words = W.present(F.col("words"))
    rows = segments.filter(SHOWN).withColumns({"__w": words})
    rows = rows.withColumn("__span", W.span(F.col("start_ms"), F.col("end_ms"), F.col("__w"))).withColumn("speech_start", F.col("__span.start_ms"))
    rows = rows.withColumn("__first", F.coalesce(F.get("__w", F.lit(0))["start_ms"], F.col("start_ms")))
    if following is not None:
        rest = following.filter(SHOWN).join(segments.select("series", "episode", "id"), ["series", "episode", "id"], "left_anti").select("series", "episode", "pos", "id", "start_ms", F.coalesce(F.get(W.present(F.col("words")), F.lit(0))["start_ms"], F.col("start_ms")).alias("__first"))
        rows = rows.withColumn("__own", F.lit(True)).unionByName(rest.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    near = ordered.neighbours(rows, ["series", "episode"], ["pos", "id"], ["__first", "start_ms"])
    if following is not None:
        near = near.filter("__own").drop("__own")
    nxt = F.col("after.__first")
    near = near.withColumns({
        "__long": F.col("__span.end_ms") - F.col("__span.start_ms") > config.anomaly_ms,
        "__read": X.visible(F.col("en")) * 1000 / config.readable_cps,
        "__isl": W.islands(F.col("__w"), config.layout_island_ms),
        "__next": nxt,
    })
    near = near.withColumn("__dom", W.dominant(F.col("__isl")))
    later = F.array_min(F.transform(F.filter("__isl", lambda i: i["start_ms"] > F.col("__dom.start_ms")), lambda i: i["start_ms"]))
    readable = lambda floor: F.least(F.lit(config.max_duration_ms), F.greatest(F.lit(floor), F.ceil("__read")))
    island_end = F.least(F.greatest(F.col("__dom.end_ms"), F.col("__dom.start_ms") + readable(config.min_duration_ms)), F.least(later, F.col("__next")) - config.min_gap_ms)
    wordless_end = F.least(F.col("__span.start_ms") + readable(config.segment_floor_ms), F.col("__next") - config.min_gap_ms)
    split = F.col("__long") & (F.size("__isl") > 1)
    bare = F.col("__long") & (F.size("__w") == 0)
    clamp = lambda v, m: max(-m, min(m, v))
    start_pad, end_pad = clamp(config.start_pad_ms, config.start_pad_limit_ms), clamp(config.end_pad_ms, config.end_pad_limit_ms)
    timed = near.withColumns({
        "__s": F.when(split, F.col("__dom.start_ms")).otherwise(F.col("__span.start_ms")),
        "__e": F.when(split, island_end).when(bare, wordless_end).otherwise(F.col("__span.end_ms")),
        "old_start_ms": F.col("__span.start_ms"), "old_end_ms": F.col("__span.end_ms"), "source_overlap": F.coalesce(F.col("end_ms") > F.col("after.start_ms"), F.lit(False)),
        "anomaly": F.col("__long"), "island_split": split, "fallback_capped": bare, "wordless": F.size("__w") == 0,
        "leading_trim": F.col("__span.start_ms") - F.col("start_ms") > config.trim_report_ms, "trailing_trim": F.col("end_ms") - F.col("__span.end_ms") > config.trim_report_ms,
    })
    begin = F.greatest(F.lit(0), F.col("__s") + start_pad)
    next_begin = F.when(F.col("__next").isNotNull(), F.greatest(F.lit(0), F.col("__next") + start_pad))  # null after the last
    gap = F.when(next_begin - F.col("__e") >= config.min_gap_ms + 50, config.min_gap_ms).otherwise(0)
    end = F.least(F.col("__e") + end_pad, next_begin - gap)
    end = F.when(split | bare, F.least(end, begin + config.max_duration_ms)).otherwise(end)
    timed = timed.withColumns({"cue_start_ms": big(begin), "cue_end_ms": big(end), "new_start_ms": F.col("__s"), "new_end_ms": F.col("__e")}).withColumn("timing_error", ~(F.col("cue_end_ms") > F.col("cue_start_ms")))
    return ordered.plain(timed).drop("__w", "__span", "__first", "__long", "__read", "__isl", "__next", "__dom", "__s", "__e", "before", "after", "speech_start")


FLAGS = ("anomaly", "island_split", "fallback_capped", "wordless", "leading_trim", "trailing_trim", "source_overlap", "moved", "asr_suspect")


def _laid_out(segments: DataFrame, glossary: DataFrame | None, config: EngineConfig, following: DataFrame | None = None) -> DataFrame:
    """Translated segments with their parts and times, and problem: why a segment can give no cue, null if it can."""
    named = segments.filter(F.trim(F.coalesce("en", F.lit(""))) != "")
    suspect = recognition_suspect(*[F.col(c) if c in segments.columns else F.lit(None).cast(t) for c, t in (("text_zh", "string"), ("avg_logprob", "double"), ("no_speech_prob", "double"))])
    timed = speech_times(named, config, following).withColumn("asr_suspect", F.coalesce(suspect, F.lit(False))).drop("words", "text_zh")
    timed = with_names(timed, glossary) if glossary is not None else timed.withColumn("names", F.lit(None).cast("array<string>"))
    duration = F.col("cue_end_ms") - F.col("cue_start_ms")
    timed = timed.withColumn("moved", (F.col("cue_start_ms") != F.col("start_ms")) | (F.col("cue_end_ms") != F.col("end_ms")))
    split = split_text(F.col("en"), F.greatest(F.lit(1), duration), F.col("names"), config, once=True)
    parts = timed.select("series", "episode", "pos", "id", "cue_start_ms", "cue_end_ms", "timing_error", X.visible(F.col("en")).alias("__v"), split.alias("parts"), *FLAGS)
    k = F.size("parts")
    room = F.greatest(F.lit(1), duration - config.min_gap_ms * (k - 1))
    parts = parts.withColumn("__gap", F.when(F.col("__v") * 1000 <= config.gap_cps * room, config.min_gap_ms).otherwise(0)).withColumn("__room", duration - F.col("__gap") * (k - 1))
    return parts.withColumn("problem", F.when(F.col("timing_error"), "no_time").when(F.col("__room") <= 0, "no_room"))


def failures(segments: DataFrame, glossary: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """series, episode, id, problem of the translated segments that ``refine`` can give no cue: 'no_time' where the next segment
    begins before this one could be shown, 'no_room' where its parts and the gaps between them don't fit; 'invalid_times'
    where its own times are none. They belong into the dead-letter table."""
    invalid = segments.filter((F.trim(F.coalesce("en", F.lit(""))) != "") & ~F.coalesce((F.col("end_ms") > F.col("start_ms")), F.lit(False))).select("series", "episode", "id", F.lit("invalid_times").alias("problem"))
    return _laid_out(segments, glossary, config).filter("problem is not null").select("series", "episode", "id", "problem").unionByName(invalid)


def corrections(segments: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """series, episode, id, old and new times of speech, reason: what was done about spans that are too long."""
    rows = speech_times(segments, config).filter("island_split or fallback_capped")
    return rows.select("series", "episode", "id", "old_start_ms", "old_end_ms", big(F.col("new_start_ms")).alias("new_start_ms"), big(F.col("new_end_ms")).alias("new_end_ms"), F.when(F.col("island_split"), "internal_speech_gap").otherwise("segment_fallback_capped").alias("reason"))


def refine(segments: DataFrame, glossary: DataFrame | None = None, config: EngineConfig = DEFAULT, following: DataFrame | None = None) -> DataFrame:
    """Cues of translated segments: series, episode, id, source_id, start_ms, end_ms, text, fixed, and the segment's flags.

    Needs series, episode, pos, id, start_ms, end_ms, words, en; text_zh, avg_logprob and no_speech_prob tell which segments
    are suspect. Segments without a translation, with a blank one or without valid times give no cue, nor do those that
    ``failures`` names. Overlaps are repaired by shortening; ids count from 1 within an episode. ``following``: see
    ``speech_times``.
    """
    flags = list(FLAGS)
    parts = _laid_out(segments, glossary, config, following).filter("problem is null")
    k = F.size("parts")
    weights = F.transform("parts", lambda p: F.greatest(F.lit(1), X.visible(p)))
    total = F.aggregate(weights, F.lit(0), lambda a, x: a + x)

    def cue(w: Column, whole: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            ahead = F.aggregate(F.slice(w, 1, i), F.lit(0), lambda a, x: a + x)
            at = lambda n: F.col("cue_start_ms") + F.floor(F.col("__room") * n / whole) + i * F.col("__gap")
            return F.struct((i + 1).alias("part"), big(at(ahead)).alias("s"), big(at(ahead + F.get(w, i))).alias("e"), p.alias("text"))

        return F.transform("parts", one)

    cues = parts.select("series", "episode", "pos", F.col("id").alias("source_id"), *flags, k.alias("n_parts"), F.inline(let(weights, lambda w: let(total, lambda t: cue(w, t)))))
    cues = cues.select("series", "episode", "pos", "part", "source_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "text", "n_parts", *flags)
    near = ordered.plain(ordered.neighbours(cues, ["series", "episode"], ["pos", "source_id", "part"], ["start_ms"]))
    end = F.least("end_ms", "after.start_ms")
    fixed = near.withColumn("fixed", F.coalesce(end < F.col("end_ms"), F.lit(False))).withColumn("end_ms", end)
    return fixed.select("series", "episode", big(F.col("position")).alias("id"), "source_id", "part", "n_parts", "start_ms", "end_ms", "text", "fixed", *flags)


def _measured(cues: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rows = cues.filter("start_ms is not null and end_ms is not null and text is not null")
    near = timeline.with_next(rows, keys, order, ["start_ms"])
    rate = F.floor(X.visible(F.col("text")) * 1_000_000 / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")))
    lines = F.split("text", "\n")
    return near.withColumns({"rate": big(rate), "lines": F.size(lines), "widest": F.array_max(F.transform(lines, lambda x: F.length(x))), "duration": F.col("end_ms") - F.col("start_ms"), "next": F.col("after.start_ms")})


def _statistics(config: EngineConfig) -> list[Column]:
    low, high, severe = config.cps_bands
    return [
        F.count("*").alias("total_cues"), F.count_if(F.col("end_ms") > F.col("next")).alias("overlaps"), F.count_if(F.col("next") - F.col("end_ms") < config.min_gap_ms - 1).alias("gap_violations"),
        F.count_if(F.col("lines") > 2).alias("over_two_lines"), F.count_if(F.col("widest") > config.line_limit).alias("long_lines"), F.count_if(F.col("duration") < config.min_duration_ms).alias("short_cues"),
        F.count_if(F.col("rate") > high * 1000).alias("high_cps_cues"), F.count_if(F.col("rate") > low * 1000).alias("high_cps_over_20"), F.count_if(F.col("rate") > severe * 1000).alias("severe_cps_over_25"),
        F.median("rate").alias("median_cps"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY rate)").alias("p95_cps"), F.max("rate").alias("max_cps"), big(F.max("lines")).alias("max_lines"), F.max("duration").alias("max_duration"),
    ]


def metrics(cues: DataFrame, keys: Sequence[str], order: Sequence[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """The fourteen statistics of the cues of each entity. Rates are characters a second times 1000, as integers."""
    return _measured(cues, keys, order).groupBy(*keys).agg(*_statistics(config))


def _awkward(text: Column, following: Column) -> Column:
    """The cue's last word shouldn't end a line, and it isn't the last cue."""
    last = F.element_at(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), -1)
    return F.coalesce((X.boundary_penalty(last, F.lit("")) >= 150) & following.isNotNull(), F.lit(False))


def awkward_boundaries(cues: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str) -> DataFrame:
    """keys, ident of the cues that end in a word which should not end a line; an entity's last cue is none of them."""
    near = timeline.with_next(cues.filter("text is not null"), keys, order, [ident])
    return near.filter(_awkward(F.col("text"), F.col("after"))).select(*keys, ident)


def issues(cues: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """series, episode, id, problem: cues that are too long, or hold an expression too wide for a line."""
    wide = F.exists(F.split("text", "\n"), lambda x: F.length(x) > config.line_limit)
    found = F.array_compact(F.array(F.when(F.col("end_ms") - F.col("start_ms") > config.anomaly_ms, "duration"), F.when(wide, "indivisible")))
    return cues.select("series", "episode", "id", F.explode(found).alias("problem"))


def rate_warnings(cues: DataFrame, keys: Sequence[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """keys, over_20, over_25: one row per entity with cues that are too fast to read."""
    rows = cues.filter("text is not null and start_ms is not null and end_ms is not null")
    rate = X.cps(F.col("text"), F.col("end_ms") - F.col("start_ms"))
    low, _, severe = config.cps_bands
    return rows.groupBy(*keys).agg(F.count_if(rate > low).alias("over_20"), F.count_if(rate > severe).alias("over_25")).filter("over_20 > 0")


def validate(cues: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """keys, ident, level, problem: one row per finding about a cue; cues without findings give none."""
    near = timeline.with_next(cues, keys, order, ["end_ms", "text"])
    duration = F.col("end_ms") - F.col("start_ms")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    found = F.array_compact(F.array(
        F.when((F.col("start_ms") < 0) | (duration <= 0) | duration.isNull(), F.struct(F.lit("error").alias("level"), F.lit("time").alias("problem"))),
        F.when((F.size(lines) > 2) | (F.array_max(F.transform(lines, lambda x: F.length(x))) > config.line_limit), F.struct(F.lit("error").alias("level"), F.lit("lines").alias("problem"))),
        F.when(duration > config.anomaly_ms, F.struct(F.lit("error").alias("level"), F.lit("long").alias("problem"))),
        F.when(F.col("before.end_ms") > F.col("start_ms"), F.struct(F.lit("error").alias("level"), F.lit("overlap").alias("problem"))),
        F.when(duration < config.short_cue_ms, F.struct(F.lit("warning").alias("level"), F.lit("short").alias("problem"))),
        F.when(F.col("text") == F.col("before.text"), F.struct(F.lit("warning").alias("level"), F.lit("repeated").alias("problem"))),
    ))
    return near.select(*keys, ident, F.inline(found))


def qc_report(cues: DataFrame, failed: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """One wide row per episode: the statistics of ``refine``'s cues and what layout did, by one aggregate over them.

    ``failed``: what ``failures`` found, counted as not_shown (null without it). Which cues are awkward or in trouble and which
    times were corrected are rows of ``awkward_boundaries``, ``issues`` and ``corrections``.
    """
    keys = ["series", "episode"]
    first = F.col("part") == 1
    of_source = lambda c: F.count_if(first & c)
    missing, sources = of_source(F.col("wordless")), F.count_if(first)
    wide, long = F.col("widest") > config.line_limit, F.col("duration") > config.anomaly_ms
    out = _measured(cues, keys, ["id"]).groupBy(*keys).agg(
        *_statistics(config),
        F.count_if("fixed").alias("overlaps_fixed"), of_source(F.col("n_parts") > 1).alias("long_cues_split"), of_source(F.col("moved") | (F.col("n_parts") > 1)).alias("timing_adjustments"), missing.alias("missing_word_timestamps"),
        of_source(F.col("anomaly")).alias("timing_anomalies_detected"), of_source(F.col("island_split") | F.col("fallback_capped")).alias("timing_anomalies_fixed"), of_source(F.col("island_split")).alias("speech_island_splits"), of_source(F.col("fallback_capped")).alias("segment_fallback_capped"),
        of_source(F.col("leading_trim")).alias("leading_silence_trimmed"), of_source(F.col("trailing_trim")).alias("trailing_silence_trimmed"), of_source(~F.col("wordless")).alias("word_bounds_used"), of_source(F.col("source_overlap")).alias("overlaps_before"),
        F.when(missing == sources, "segment").when(missing > 0, "mixed").otherwise("word").alias("timing_alignment"), F.count_if(F.col("rate") > config.cps_bands[0] * 1000).alias("needs_condensation"),
        of_source(F.col("anomaly")).alias("long_duration_cues_before"), F.count_if(long).alias("long_duration_cues_after"), (F.count_if(long) + F.count_if(wide)).alias("issues"), F.count_if(_awkward(F.col("text"), F.col("next"))).alias("awkward_split_warnings"),
        of_source(F.col("asr_suspect")).alias("asr_suspect"), F.lit(0).cast("bigint").alias("splits_rejected_due_to_cps"),
        *[F.sum(X.phrase_counts(F.col("text"))[p.lower().replace(" ", "_")]).alias("phrase_" + p.lower().replace(" ", "_")) for p in X.TRANSLATIONESE],
    )
    if failed is None:
        return out.withColumn("not_shown", F.lit(None).cast("bigint"))
    lost = failed.groupBy(*keys).agg(F.count("*").alias("not_shown"))
    return out.join(lost, keys, "left").withColumn("not_shown", F.coalesce("not_shown", F.lit(0)))


def timing_drift(cues: DataFrame, segments: DataFrame, before_ms: int = 51, after_ms: int = 101) -> DataFrame:
    """series, episode, ok: whether every cue lies within its source's times, with a tolerance."""
    source = segments.select("series", "episode", F.col("id").alias("source_id"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    within = (F.col("start_ms") >= F.col("s") - before_ms) & (F.col("end_ms") <= F.col("e") + after_ms)
    return cues.join(source, ["series", "episode", "source_id"]).groupBy("series", "episode").agg(F.bool_and(within).alias("ok"))
