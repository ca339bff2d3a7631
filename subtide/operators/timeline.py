"""Interval algebra and sequence operators of a timeline keyed by entity (usually series and episode)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.config import DEFAULT, EngineConfig
from subtide.functions import words as W
from subtide.operators import ordered
from subtide.operators.periods import periods_and_gaps
from subtide.session import durable

HOUR_MS = 3_600_000


def islands(df: DataFrame, keys: Sequence[str], gap_ms: int, tie: Sequence[str] = (), block: int = HOUR_MS) -> DataFrame:
    """keys, island (its first row's position), start_ms, end_ms, n: rows in order of start, cut where a row starts more
    than ``gap_ms`` after the end of the row right before it. Rows with a null time are ignored; an empty table gives
    no rows; ``tie`` orders rows of one start."""
    rows = df.filter("start_ms is not null and end_ms is not null")
    order = ["start_ms", "end_ms", *tie]
    near = ordered.neighbours(rows, keys, order, ["end_ms"], block)
    labelled = ordered.labels(near, order, F.col("before").isNull() | (F.col("start_ms") - F.col("before.end_ms") > gap_ms))
    out = labelled.groupBy(*keys, "label").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    return out.withColumnRenamed("label", "island")


def union_intervals(df: DataFrame, keys: Sequence[str], join_ms: int = 0, tie: str | None = None) -> DataFrame:
    """keys, start_ms, end_ms, n: the union, where intervals no more than ``join_ms`` apart are joined. Intervals of no
    length and null times are ignored. ``tie``: a column that spreads equal intervals over partitions."""
    extra = [F.col(tie).alias("__tie")] if tie else []
    longer = df.select(*keys, "start_ms", (F.col("end_ms") + join_ms).alias("end_ms"), F.col("end_ms").alias("__end"), *extra).filter("__end > start_ms")
    out = periods_and_gaps(longer, keys, tie="__tie" if tie else None).filter("kind = 'period'")
    return out.select(*keys, "start_ms", (F.col("end_ms") - join_ms).alias("end_ms"), F.col("n_rows").alias("n"))


def subtract_intervals(df: DataFrame, cover: DataFrame, keys: Sequence[str], ident: str, min_ms: int = 0, block: int = HOUR_MS, tie: str | None = None) -> DataFrame:
    """keys, ident, start_ms, end_ms: what the cover leaves of each interval of ``df``, in pieces of ``min_ms`` at least.

    One carried sweep over the cover gives its periods and gaps; a piece is what an interval shares with one gap, or what lies
    before the first period or after the last. Intervals and gaps meet in an equi-join on entity and time block, and the
    first block that a pair shares reports it. Intervals of ``df`` shorter than ``min_ms`` are dropped first. Null keys match
    null keys; an interval of an entity without cover is left whole; repeated rows of one ident give their pieces each.
    ``tie``: a column of the cover that spreads equal intervals over partitions.
    """
    least = max(1, min_ms)
    k = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__k")
    own = df.filter(F.col("end_ms") - F.col("start_ms") >= least).select(k, *keys, ident, "start_ms", "end_ms")
    swept = durable(periods_and_gaps(cover.select(*keys, "start_ms", "end_ms", *([tie] if tie else [])), keys, tie=tie).select(k, "kind", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce")))
    edges = swept.filter("kind = 'period'").groupBy("__k").agg(F.min("cs").alias("first"), F.max("ce").alias("last"))
    outer = own.join(edges, "__k", "left")
    ends = F.when(F.col("first").isNull(), F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))).otherwise(
        F.array(F.struct(F.col("start_ms").alias("s"), F.least("end_ms", "first").alias("e")), F.struct(F.greatest("start_ms", "last").alias("s"), F.col("end_ms").alias("e")))
    )
    outer = outer.select(*keys, ident, F.inline(ends))
    blocks = lambda s, e: F.explode(F.sequence(F.floor(s / block), F.floor((e - 1) / block)))
    gaps = swept.filter((F.col("kind") == "gap") & (F.col("ce") - F.col("cs") >= least)).select("__k", "cs", "ce", blocks(F.col("cs"), F.col("ce")).alias("__b"))
    cut = own.withColumn("__b", blocks(F.col("start_ms"), F.col("end_ms")))
    s, e = F.greatest("start_ms", "cs"), F.least("end_ms", "ce")
    inner = cut.join(gaps, ["__k", "__b"]).filter((e > s) & (F.col("__b") == F.floor(s / block))).select(*keys, ident, s.alias("s"), e.alias("e"))
    whole = outer.unionByName(inner)
    return whole.filter(F.col("e") - F.col("s") >= least).select(*keys, ident, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def uncovered_windows(speech: DataFrame, segments: DataFrame, keys: Sequence[str], config: EngineConfig = DEFAULT, tie: str | None = None) -> DataFrame:
    """keys, start_ms, end_ms: speech that no segment covers, padded and joined. Each speech interval is subtracted on
    its own; intervals of equal bounds count once."""
    own = speech.filter(f"end_ms - start_ms >= {config.min_speech_ms}").select(*keys, "start_ms", "end_ms").distinct()
    own = own.withColumn("__id", F.xxhash64("start_ms", "end_ms"))
    left = subtract_intervals(own, segments, keys, "__id", config.min_uncovered_ms, tie=tie)
    padded = left.select(*keys, F.greatest(F.lit(0), F.col("start_ms") - config.window_pad_ms).alias("start_ms"), (F.col("end_ms") + config.window_pad_ms).alias("end_ms"))
    return union_intervals(padded, keys, config.window_join_ms).select(*keys, "start_ms", "end_ms")


def range_neighbours(windows: DataFrame, rows: DataFrame, keys: Sequence[str], within_ms: int = DEFAULT.neighbour_ms, block: int = 60_000) -> DataFrame:
    """Every window with every row of its entity that ends after its start less ``within_ms`` and starts before its end
    plus ``within_ms``. Columns of ``rows`` other than the keys come with the prefix row_. An equi-join on time blocks."""
    w = windows.filter("start_ms is not null and end_ms >= start_ms").withColumn("__w", F.explode(F.sequence(F.floor((F.col("start_ms") - within_ms) / block), F.floor((F.col("end_ms") + within_ms) / block))))
    r = rows.filter("start_ms is not null and end_ms >= start_ms").withColumn("__r", F.explode(F.sequence(F.floor(F.col("start_ms") / block), F.floor(F.col("end_ms") / block))))
    r = r.select(*[F.col(f"`{c}`").alias(f"row_{c}") for c in r.columns if c != "__r"], "__r")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"row_{key}"))
    near = (F.col("row_end_ms") > F.col("start_ms") - within_ms) & (F.col("row_start_ms") < F.col("end_ms") + within_ms)
    # A pair meets in every block that both touch; the first of these reports it.
    first = F.greatest(F.floor((F.col("start_ms") - within_ms) / block), F.floor(F.col("row_start_ms") / block))
    return w.join(r, same & (F.col("__w") == F.col("__r")) & near).filter(F.col("__w") == first).drop("__w", "__r", *[f"row_{k}" for k in keys])


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], block: int = ordered.BLOCK) -> DataFrame:
    return ordered.plain(ordered.neighbours(df, keys, order, carry, block))


def repair_overlaps(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with end_ms no later than the next row's start, and fixed (whether it was). Starts never move."""
    near = with_next(df, keys, order, ["start_ms"])
    end = F.least("end_ms", "after.start_ms")
    return near.withColumn("fixed", F.coalesce(end < F.col("end_ms"), F.lit(False))).withColumn("end_ms", end).drop("before", "after", "position")


def adjacent_violations(df: DataFrame, keys: Sequence[str], order: Sequence[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """keys, overlaps, gap_violations: how often a row ends after the next starts, or less than the least gap before."""
    near = with_next(df, keys, order, ["start_ms"])
    nxt = F.col("after.start_ms")
    return near.groupBy(*keys).agg(F.count_if(F.col("end_ms") > nxt).alias("overlaps"), F.count_if(nxt - F.col("end_ms") < config.min_gap_ms - 1).alias("gap_violations"))


def adjacent_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, ident: str) -> DataFrame:
    """keys, ident, text: rows whose text equals that of the row right before."""
    near = with_next(df, keys, order, [text])
    return near.filter(F.col(text) == F.col(f"before.{text}")).select(*keys, ident, text)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each entity; a group limit cuts each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def batches(df: DataFrame, position: str, size: int = DEFAULT.batch_size) -> DataFrame:
    return df.withColumn("batch", F.floor((F.col(position) - 1) / size))


def context_frames(df: DataFrame, keys: Sequence[str], position: str, text: str, config: EngineConfig = DEFAULT, block: int = ordered.BLOCK) -> DataFrame:
    """keys, batch, previous, following: the texts of the rows around each batch of positions. ``position`` is dense.

    Rows near a border of a batch are sent to the neighbour that they serve, so no window over an entity is needed.
    """
    size, before, after = config.batch_size, config.context_before, config.context_after
    if max(before, after) > size:
        raise ValueError("a frame reaches no further than the next batch")
    at = F.col(position) - 1
    own, inner = F.floor(at / size), at % size
    target = F.array_compact(F.array(F.struct(own.alias("batch"), F.lit("own").alias("side")), F.when(inner >= size - before, F.struct((own + 1).alias("batch"), F.lit("previous").alias("side"))), F.when(inner < after, F.struct((own - 1).alias("batch"), F.lit("following").alias("side")))))
    sent = df.select(*keys, F.col(position).alias("p"), F.col(text).alias("x"), F.inline(target))
    item = F.struct("p", "x")
    frame = sent.groupBy(*keys, "batch").agg(  # at most size + before + after rows
        F.count_if(F.col("side") == "own").alias("n"), F.array_sort(F.collect_list(F.when(F.col("side") == "previous", item))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("side") == "following", item))).alias("z")
    )
    return frame.filter("n > 0").select(*keys, "batch", F.transform("a", lambda x: x["x"]).alias("previous"), F.transform("z", lambda x: x["x"]).alias("following"))


def sentence_split(segments: DataFrame) -> DataFrame:
    """Segments cut into sentences by their words; segments without words are kept whole. Adds sentence (from 1)."""
    words = W.present(F.col("words"))
    whole = F.array(F.struct("start_ms", "end_ms", F.trim("text_zh").alias("text"), F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,word:string>>").alias("words")))
    cut = segments.withColumn("__s", F.coalesce(W.sentences(words), whole))
    keep = [c for c in segments.columns if c not in ("start_ms", "end_ms", "text_zh", "words")]
    return cut.select(*keep, F.posexplode("__s").alias("__i", "s")).select(*keep, (F.col("__i") + 1).cast("bigint").alias("sentence"), "s.start_ms", "s.end_ms", F.col("s.text").alias("text_zh"), "s.words").filter("text_zh <> ''")


def proportional_times(df: DataFrame, keys: Sequence[str], order: str, weight: str, start: str, available: str, gap: str) -> DataFrame:
    """Parts of one segment share its available time by weight; part i starts at the floor of the share before it plus
    the gaps, so neighbours never overlap. keys tell segments apart; their parts are few by construction."""
    before = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    total, ahead = F.sum(weight).over(whole), F.coalesce(F.sum(weight).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    i = F.row_number().over(before) - 1
    return df.withColumns({"part_start_ms": F.col(start) + F.floor(F.col(available) * ahead / total) + i * F.col(gap), "part_end_ms": F.col(start) + F.floor(F.col(available) * (ahead + F.col(weight)) / total) + i * F.col(gap)})
