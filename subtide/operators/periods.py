"""Continuous periods and gaps of overlapping intervals, by a global range sort and a carried scan.

1. The intervals are range-partitioned by (entity, start, end, tie) and sorted, so an entity that holds any share of
   the rows is spread over as many partitions as its rows need. The sorted rows are checkpointed, since both passes
   must see the same partitions.
2. Each partition gives one summary row: its first and last entity and, for the last, the largest end so far and the
   start of the island that is open.
3. The summaries (one per partition, never more than the number of shuffle partitions) are combined from left to
   right into the state that each partition starts from.
4. The partitions are scanned again with that state; every row learns the label of its island (the island's start),
   rows are reduced to one piece per island and batch, and pieces are merged by a hash aggregate on the label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.session import durable

SUMMARY = "pid int, first_e string, last_e string, tail_max bigint, tail_start bigint, single boolean"
PIECE = "e string, kind string, lo bigint, hi bigint, n bigint, shared boolean"


def _scan(e: np.ndarray, s: np.ndarray, t: np.ndarray, state: tuple | None) -> tuple:
    """Label sorted intervals. state: (entity, largest end, island start) before them. Returns, by row, whether an
    entity and whether an island begins, the largest end before the row, the label, and the state after."""
    n = len(e)
    new = np.ones(n, dtype=bool)
    new[1:] = e[1:] != e[:-1]
    if state is not None:
        new[0] = e[0] != state[0]
    code = np.cumsum(new)
    most = pd.Series(t).groupby(code).cummax().to_numpy().copy()
    if not new[0]:
        first = code == code[0]
        most[first] = np.maximum(most[first], state[1])
    before = np.empty(n, dtype=np.int64)
    before[1:] = most[:-1]
    before[0] = state[1] if not new[0] else 0
    begins = new | (s > before)
    at = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
    label = np.where(at >= 0, s[at], state[2] if state is not None else 0)
    return new, begins, before, label, (e[-1], int(most[-1]), int(label[-1]))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, first, pid, single = None, None, None, True
    for batch in batches:
        if len(batch) == 0:
            continue
        e, s, t = batch["e"].to_numpy(object), batch["s"].to_numpy(np.int64), batch["t"].to_numpy(np.int64)
        if first is None:
            first, pid = e[0], int(batch["pid"].iloc[0])
        single = single and e[-1] == first
        state = _scan(e, s, t, state)[-1]
    if state is not None:
        yield pd.DataFrame({"pid": [pid], "first_e": [first], "last_e": [state[0]], "tail_max": [state[1]], "tail_start": [state[2]], "single": [single]})


def combine(summaries: Sequence[dict]) -> dict[int, tuple]:
    """The state with which each partition begins, from the summaries of all."""
    carried: dict[int, tuple] = {}
    state: tuple | None = None
    for row in sorted(summaries, key=lambda r: r["pid"]):
        if state is not None:
            carried[row["pid"]] = state
        own = (row["last_e"], row["tail_max"], row["tail_start"])
        if state is not None and row["single"] and row["first_e"] == state[0]:
            start = state[2] if own[2] <= state[1] else own[2]
            own = (own[0], max(state[1], own[1]), start)
        state = own
    return carried


def _pieces(carried: dict[int, tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, begun = None, False
        for batch in batches:
            if len(batch) == 0:
                continue
            if not begun:
                state, begun = carried.get(int(batch["pid"].iloc[0])), True
            e, s, t = batch["e"].to_numpy(object), batch["s"].to_numpy(np.int64), batch["t"].to_numpy(np.int64)
            new, begins, before, label, state = _scan(e, s, t, state)
            shared = ~begins & (s < before)
            at = np.flatnonzero(begins)
            cuts = at if len(at) and at[0] == 0 else np.r_[0, at]
            yield pd.DataFrame({"e": e[cuts], "kind": "period", "lo": label[cuts], "hi": np.maximum.reduceat(t, cuts), "n": np.diff(np.r_[cuts, len(e)]), "shared": np.logical_or.reduceat(shared, cuts)})
            gap = begins & ~new
            if gap.any():
                yield pd.DataFrame({"e": e[gap], "kind": "gap", "lo": before[gap], "hi": s[gap], "n": 0, "shared": False})

    return run


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", tie: str | None = None, partitions: int | None = None) -> DataFrame:
    """The continuous periods that the intervals of each entity cover, and the gaps between them.

    Returns the keys, kind ('period' or 'gap'), start_ms, end_ms, n_rows and shared (whether two intervals of the
    period share more than no time). Intervals that overlap or touch belong to one period. Rows with a null or
    inverted time and rows of no length are ignored; a null key is an entity of its own; repeated rows count each time;
    an empty table gives no rows; columns other than the keys and times are not read. ``tie``: a column that spreads
    equal intervals over partitions.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField(k, df.schema[k].dataType, True) for k in keys])
    entity = F.to_json(F.struct(*[F.col(f"`{k}`").alias(k) for k in keys]), {"ignoreNullFields": "false"})
    rows = df.select(entity.alias("e"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("t"), (F.col(tie) if tie else F.lit(0)).alias("tie"))
    rows = rows.filter("s is not null and t is not null and t > s")
    rows = rows.repartitionByRange(partitions, "e", "s", "t", "tie").sortWithinPartitions("e", "s", "t").drop("tie")
    rows = durable(rows.withColumn("pid", F.spark_partition_id()))
    carried = combine([r.asDict() for r in rows.mapInPandas(_summaries, SUMMARY).collect()])  # one row per partition
    pieces = rows.mapInPandas(_pieces(carried), PIECE)
    merged = pieces.groupBy("e", "kind", "lo", F.when(F.col("kind") == "gap", F.col("hi")).alias("gap_hi")).agg(F.max("hi").alias("hi"), F.sum("n").alias("n_rows"), F.bool_or("shared").alias("shared"))
    key = F.from_json("e", schema)
    return merged.select(*[key[k].alias(k) for k in keys], "kind", F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"), "n_rows", "shared")
