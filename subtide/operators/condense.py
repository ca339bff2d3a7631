"""Shortening of cues that are too fast to read: selection, risks, acceptance per episode."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.config import DEFAULT, EngineConfig
from subtide.functions import text as X
from subtide.operators import layout
from subtide.operators import memory as M
from subtide.session import durable

KEYS = ["series", "episode"]
#: What a shortened text must not lose.
CAUSAL = ("because", "so that", "so ", "therefore", "thus", "hence", "in order to", "if ", "unless", "when ", "before", "after", "while", "until")
LORE_EN = ("reincarnation", "dao", "heaven", "tribulation", "sage", "realm", "cultivation", "cycle", "essence", "soul", "immortal")
LORE_ZH = ("轮回", "天道", "洪荒", "因果", "业火", "转世")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return F.coalesce(hit, F.lit(False))


def risk_reasons(source: Column, old: Column, new: Column, config: EngineConfig = DEFAULT) -> Column:
    """array<string>: why the shorter text has to be verified."""
    low_old, low_new = F.lower(old), F.lower(new)
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(X.numbers(old), X.numbers(new))) > 0, "numbers"),
        F.when((X.visible(old) > 0) & (X.visible(new) < X.visible(old) * config.compression_floor), "aggressive_compression"),
        F.when(_any(low_old, LORE_EN) | _any(source, LORE_ZH), "lore"),
        F.when(_any(low_old, CAUSAL) != _any(low_new, CAUSAL), "causal_temporal"),
        F.when(F.regexp_count(old, F.lit(",")) > F.regexp_count(new, F.lit(",")), "clause_collapse"),
    ))


def severe_sources(cues: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """series, episode, source_id: with a cue above the severe rate."""
    return cues.filter(X.cps(F.col("text"), F.col("end_ms") - F.col("start_ms")) > config.cps_bands[2]).select(*KEYS, "source_id").distinct()


def source_durations(cues: DataFrame) -> DataFrame:
    return cues.groupBy(*KEYS, "source_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def condensation_signature(source: Column, old: Column, style: str, version: str, mappings: Column) -> Column:
    return X.signature(F.lit("condense-v1"), source, old, F.lit(style), F.lit(version), mappings)


CONTEXT = 2
_LINE = "struct<pos:bigint,zh:string,en:string>"


def _around(targets: DataFrame, segments: DataFrame) -> DataFrame:
    """``targets`` with previous and following: the texts of the two segments before and after each, in order."""
    rows = segments.select(*KEYS, F.col("pos").cast("bigint").alias("__p"), F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("text_zh").alias("zh"), "en").alias("__x"))
    steps = [d for d in range(-CONTEXT, CONTEXT + 1) if d]
    asked = targets.select(*KEYS, "source_id", F.col("pos").alias("__at"), F.explode(F.array(*[(F.col("pos") + d).cast("bigint") for d in steps])).alias("__p"))
    met = asked.join(rows, [*KEYS, "__p"]).groupBy(*KEYS, "source_id").agg(  # at most four rows
        F.array_sort(F.collect_list(F.when(F.col("__p") < F.col("__at"), F.col("__x")))).alias("previous"), F.array_sort(F.collect_list(F.when(F.col("__p") > F.col("__at"), F.col("__x")))).alias("following")
    )
    none = F.array().cast(f"array<{_LINE}>")
    return targets.join(met, [*KEYS, "source_id"], "left").withColumns({"previous": F.coalesce("previous", none), "following": F.coalesce("following", none)})


def _layout_state(cues: DataFrame, config: EngineConfig) -> DataFrame:
    """series, episode, source_id, wide (lines too long), severe (cues too fast) of laid out cues."""
    wide = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) > config.line_limit))
    fast = X.cps(F.col("text"), F.col("end_ms") - F.col("start_ms")) > config.cps_bands[2]
    return cues.groupBy(*KEYS, "source_id").agg(F.sum(wide).alias("wide"), F.count_if(fast).alias("severe"))


def _lines(rows) -> list[dict]:
    return [dict(zh=r["zh"], en=r["en"]) for r in (rows if rows is not None else [])]


def condense(segments: DataFrame, cues: DataFrame, generate: Callable[..., str], verify: Callable[..., str], entries: DataFrame, cache: DataFrame | None = None, config: EngineConfig = DEFAULT, glossary: DataFrame | None = None, style: str = "", version: str = "") -> DataFrame:
    """series, episode, source_id, signature, outcome, original, condensed, old_rate, new_rate, generated, verified for every
    severe source.

    generate(source, old, previous, following) gives a shorter text, verify(source, old, new, previous, following) gives
    ACCEPT or not; previous and following are the two segments on either side, as {'zh', 'en'}. segments: as for ``refine``.
    outcome: cache_hit, accepted, no_improvement, terminology, semantic_risk.

    A new text is laid out before it is accepted: it must not raise the number of cues that are too fast, and afterwards the
    episode may hold no line that is too long. A source's place depends on its own text and the start of the next, so every
    trial is one layout of all sources, and what other sources contribute is known: their lines that are too long, of
    which an accepted source earlier in the episode may have removed the last. Cached texts are always laid out again.
    """
    targets = severe_sources(cues, config).join(segments.select(*KEYS, F.col("id").alias("source_id"), "pos", "text_zh", F.col("en").alias("original")), [*KEYS, "source_id"])
    targets = targets.join(source_durations(cues), [*KEYS, "source_id"])
    hard = M.resolve(targets, entries, "text_zh").filter(F.col("authority").isin(*M.HARD))
    need = hard.groupBy("series", F.col("text").alias("text_zh")).agg(F.array_sort(F.collect_set("en")).alias("required"))  # of one text
    targets = targets.join(need, ["series", "text_zh"], "left").withColumn("required", F.coalesce("required", F.array().cast("array<string>")))
    targets = targets.withColumn("signature", condensation_signature(F.col("text_zh"), F.col("original"), style, version, F.col("required")))
    if cache is not None:
        held = M.latest_by(cache, ["series", "signature"]).select("series", "signature", F.get_json_object("payload", "$.translation").alias("cached"))
        targets = targets.join(held, ["series", "signature"], "left")
    else:
        targets = targets.withColumn("cached", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def shorter(source: pd.Series, old: pd.Series, cached: pd.Series, previous: pd.Series, following: pd.Series) -> pd.Series:
        return pd.Series([c if c is not None else generate(s, o, _lines(p), _lines(f)) for s, o, c, p, f in zip(source, old, cached, previous, following, strict=True)])

    # Cut after each paid call: a rerun must not ask again.
    proposed = durable(_around(targets, segments).withColumn("condensed", shorter("text_zh", "original", "cached", "previous", "following")))
    lost = F.exists("required", lambda r: ~F.col("condensed").contains(r))
    risky = F.size(risk_reasons(F.col("text_zh"), F.col("original"), F.col("condensed"), config)) > 0

    @F.pandas_udf("string")
    def verdict(source: pd.Series, old: pd.Series, new: pd.Series, previous: pd.Series, following: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else verify(s, o, n, _lines(p), _lines(f)) for s, o, n, p, f in zip(source, old, new, previous, following, strict=True)])

    shortened = (X.visible(F.coalesce("condensed", F.lit(""))) > 0) & (X.visible(F.col("condensed")) < X.visible(F.col("original")))
    open_case = F.coalesce(F.col("cached").isNull() & shortened & ~lost, F.lit(False))
    asked = proposed.withColumns({"open_case": open_case, "verified": open_case & risky})
    asked = durable(asked.withColumn("verdict", verdict("text_zh", "original", F.when(F.col("verified"), F.col("condensed")), "previous", "following")))
    passed = F.col("open_case") & (~F.col("verified") | F.col("verdict").eqNullSafe("ACCEPT"))

    # The trial: every text that may be accepted, or comes from the cache, laid out at once.
    trial = asked.filter(passed | F.col("cached").isNotNull()).select(*KEYS, F.col("source_id").alias("id"), F.col("condensed").alias("__new"))
    laid = layout.refine(segments.join(trial, [*KEYS, "id"]).withColumn("en", F.col("__new")).drop("__new"), glossary, config, following=segments)
    before, after = _layout_state(cues, config), _layout_state(laid, config)
    wide = before.filter("wide > 0").groupBy(*KEYS).agg(F.count("*").alias("n_wide"), F.min("source_id").alias("wide_id"))
    state = asked.join(before.withColumnsRenamed({"wide": "old_wide", "severe": "old_severe"}), [*KEYS, "source_id"], "left").join(after, [*KEYS, "source_id"], "left").join(wide, KEYS, "left")
    own = (F.coalesce("wide", F.lit(1)) == 0) & (F.coalesce("severe", F.lit(1)) <= F.coalesce("old_severe", F.lit(0)))
    alone = F.col("n_wide").isNull() | ((F.col("n_wide") == 1) & (F.col("wide_id") == F.col("source_id")))
    state = state.withColumns({"passed": passed, "fits": own & alone, "own": own})
    freed = state.filter(((F.col("passed") & F.col("fits")) | (F.col("cached").isNotNull() & (F.col("wide") == 0))) & (F.col("n_wide") == 1) & (F.col("wide_id") == F.col("source_id"))).select(*KEYS, F.col("pos").alias("freed_at"))
    state = state.join(freed, KEYS, "left").withColumn("fits", F.col("fits") | (F.col("own") & F.coalesce(F.col("pos") > F.col("freed_at"), F.lit(False))))
    outcome = (
        F.when(F.col("cached").isNotNull(), "cache_hit").when(~F.coalesce(shortened, F.lit(False)), "no_improvement").when(lost, "terminology")
        .when(F.col("verified") & ~F.col("verdict").eqNullSafe("ACCEPT"), "semantic_risk").when(~F.col("fits"), "no_improvement").otherwise("accepted")
    )
    rate = lambda c: F.floor(X.visible(F.col(c)) * 1_000_000 / F.greatest(F.lit(1), F.col("duration_ms")))
    return state.select(*KEYS, "source_id", "signature", outcome.alias("outcome"), "original", "condensed", rate("original").alias("old_rate"), rate("condensed").alias("new_rate"), F.col("cached").isNull().alias("generated"), "verified", "open_case")


OUTCOMES = ("cache_hit", "accepted", "no_improvement", "terminology", "semantic_risk")


def outcome_counts(condensed: DataFrame) -> DataFrame:
    """The ten counters of each episode: every outcome, cache misses, and what was asked of the model."""
    miss = F.col("outcome") != "cache_hit"
    return condensed.groupBy(*KEYS).agg(
        F.count("*").alias("targeted"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count_if(miss).alias("cache_miss"), F.count_if("generated").alias("generation"), F.count_if("verified").alias("verification"),
        F.count_if(F.col("open_case") & ~F.col("verified")).alias("verification_avoided"),
    )


def cache_entries(condensed: DataFrame, seq: int) -> DataFrame:
    """series, signature, payload, seq of what was accepted, for the condensation cache."""
    return condensed.filter("outcome = 'accepted'").select("series", "signature", F.to_json(F.struct(F.col("condensed").alias("translation"))).alias("payload"), F.lit(seq).cast("bigint").alias("seq")).distinct()


def apply(segments: DataFrame, condensed: DataFrame) -> DataFrame:
    """Segments with the accepted and cached texts, to be laid out again."""
    new = condensed.filter(F.col("outcome").isin("accepted", "cache_hit")).select(*KEYS, F.col("source_id").alias("id"), F.col("condensed").alias("__new"))
    return segments.join(new, [*KEYS, "id"], "left").withColumn("en", F.coalesce("__new", "en")).drop("__new")
