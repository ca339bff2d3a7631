"""Runs of consecutive near-identical events (problem 5).

Boundary rows only: a row that differs from the row right before it begins a run. Over the boundary rows ``lead`` gives
where the next run begins: the difference of their positions is the count, and what the next boundary saw right before it
(the last row, and the largest end of that run so far) closes the run.

The sequence of an entity is cut into blocks of its order column, so an entity that holds any share of the rows is spread
over many tasks. A block's first row is a boundary for the time being. Only the first and the last run of each block can be
parts of a longer one; these edges, two rows per block at most, are put together in a window over the edges of the entity.
So the rows are shuffled once, by entity and block, and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_event(a: Column, b: Column, near: int = 8) -> Column:
    """Equal and not empty, or one character apart while both have at least ``near``."""
    close = (F.length(a) >= near) & (F.length(b) >= near) & (F.levenshtein(a, b, 1) >= 0)
    return F.coalesce((a != "") & ((a == b) | close), F.lit(False))


def collapse_runs(df: DataFrame, keys: Sequence[str], order: str, ident: str, text: str, max_gap_ms: int = 3000, near: int = 8, singletons: bool = True, block: int = 4096) -> DataFrame:
    """One event per run: keys, first_id, last_id, n, start_ms, end_ms (the largest), duration_ms, text (of the first).

    A row continues the run of the row right before it when it starts at most ``max_gap_ms`` after that row's end_ms and
    their texts (lower case, letters and digits only) are the same event. Rows without valid times are not in the
    sequence. A null text never continues a run; null keys form an entity; a null order comes first; equal orders are
    ordered by ``ident``, and so are null ones. ``singletons``: also give rows that no other row continues. Empty tables
    give no rows; columns other than those named are not read.
    """
    keys = list(keys)
    plain = F.lower(F.regexp_replace(F.col(text), r"[^\p{L}\p{N}]", ""))
    rows = df.filter("start_ms is not null and end_ms is not null and end_ms > start_ms").select(
        *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")).alias(f"e{i}") for i, k in enumerate(keys)], F.col(order).cast("bigint").alias("o"), F.col(ident).cast("bigint").alias("id"),
        F.col("start_ms").cast("bigint").alias("s"), F.col("end_ms").cast("bigint").alias("t"), F.col(text).alias("text"), F.coalesce(plain, F.lit("")).alias("p"),
    )
    e = [f"e{i}" for i in range(len(keys))]
    # Null orders are cut by the identifier, in blocks that come before all others.
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col("o") / block), F.lit(-(2**53)) + F.floor(F.col("id") / block)))
    inside = Window.partitionBy(*e, "b").orderBy(F.col("o").asc_nulls_first(), "id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumns({"n": F.row_number().over(inside), "before": F.lag(F.struct("id", "t", "p")).over(inside), "last": F.lead("id").over(inside).isNull()})
    before = F.col("before")
    continues = F.coalesce(same_event(F.col("p"), before["p"], near) & (F.col("s") <= before["t"] + max_gap_ms), F.lit(False))
    here = here.withColumn("boundary", ~continues)
    # The largest end of the open run: its boundary only grows, so the largest pair belongs to it.
    here = here.withColumn("at", F.max(F.when(F.col("boundary"), F.col("n"))).over(so_far))
    here = here.withColumn("end", F.max(F.struct("at", "t")).over(so_far)["t"])
    here = here.withColumn("end_before", F.lag("end").over(inside))

    # Boundary rows, and each block's last row, which closes its last run.
    kept = here.filter("boundary or last")
    follow = F.lead(F.struct("boundary", "n", "before", "end_before", "end", F.struct("id", "t", "p").alias("own"))).over(inside)
    starts = kept.withColumns({"next": follow, "place": F.row_number().over(inside)}).filter("boundary")
    closed, open_ = F.col("next.boundary"), F.col("next.n").isNotNull()
    own = F.struct("id", "t", "p")
    pieces = starts.select(
        *e, "b", "n", "id", "s", "text", "p",
        F.when(closed, F.col("next.n") - F.col("n")).when(open_, F.col("next.n") - F.col("n") + 1).otherwise(1).cast("bigint").alias("count"),
        F.when(closed, F.col("next.end_before")).when(open_, F.col("next.end")).otherwise(F.col("t")).alias("t"),
        F.when(closed, F.col("next.before")).when(open_, F.col("next.own")).otherwise(own).alias("tail"),
        (F.col("n") == 1).alias("opens"), (~F.coalesce(closed, F.lit(False))).alias("closes"),
    )
    inner = pieces.filter("not opens and not closes")
    if not singletons:
        inner = inner.filter("count >= 2")
    final = ["first_id", "last_id", "n", "start_ms", "end_ms", "text"]
    inner = inner.select(*e, F.col("id").alias("first_id"), F.col("tail.id").alias("last_id"), F.col("count").alias("n"), F.col("s").alias("start_ms"), F.col("t").alias("end_ms"), "text")

    # Edges, two per block at most: a block's first run goes on where the last one of the block before stopped.
    edges = Window.partitionBy(*e).orderBy("b", "n")
    edge = pieces.filter("opens or closes").withColumn("prev", F.lag("tail").over(edges))
    goes_on = F.col("opens") & F.coalesce(same_event(F.col("p"), F.col("prev.p"), near) & (F.col("s") <= F.col("prev.t") + max_gap_ms), F.lit(False))
    edge = edge.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(edges))
    place = F.struct("b", "n")
    joined = edge.groupBy(*e, "run").agg(
        F.min_by("id", place).alias("first_id"), F.max_by("tail.id", place).alias("last_id"), F.sum("count").alias("n"), F.min_by("s", place).alias("start_ms"), F.max("t").alias("end_ms"), F.min_by("text", place).alias("text")
    )
    if not singletons:
        joined = joined.filter("n >= 2")
    events = inner.select(*e, *final).unionByName(joined.select(*e, *final))
    back = [F.when(F.col(f"e{i}") != "\0", F.col(f"e{i}")).cast(df.schema[name].dataType).alias(name) for i, name in enumerate(keys)]
    return events.select(*back, "first_id", "last_id", "n", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "text")
