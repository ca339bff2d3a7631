"""Extensions for episodes that arrive over time; the batch operators are the reference for their results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from subtide.config import DEFAULT, EngineConfig


def first_deliveries(stream: DataFrame, keys: list[str], time: str = "ingested_at", delay: str = "1 day") -> DataFrame:
    """Each key once, as it first arrives; state older than ``delay`` is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def speech_sessions(stream: DataFrame, keys: list[str], time: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """keys, start, end, n: events no further apart than ``gap``; a session is given out when the watermark passes it."""
    window = F.session_window(time, gap)
    out = stream.withWatermark(time, delay).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def observe_stream(stream: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """series, source, en, seq, event ('promoted' or 'conflict'): terms learnt from occurrences as they arrive.

    The state of a source is its first rendering, whether another was seen, how many trusted occurrences it has, and the
    rendering once established. Occurrences of one batch are taken in the order of seq; deduplicate them before.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, mixed, trusted, held = state.get if state.exists else (None, False, 0, None)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if held is not None:
                if row.en != held:
                    out.append((*key, row.en, row.seq, "conflict"))
                continue
            first = row.en if first is None else first
            mixed = mixed or row.en != first
            trusted += not bool(row.suspect)
            if not mixed and trusted >= config.promote_after:
                held = first
                out.append((*key, held, row.seq, "promoted"))
        state.update((first, mixed, trusted, held))
        yield pd.DataFrame(out, columns=["series", "source", "en", "seq", "event"])

    rows = stream.filter("en is not null").select("series", "source", "en", F.col("seq").cast("bigint").alias("seq"), F.coalesce("suspect", F.lit(False)).alias("suspect"))
    return rows.groupBy("series", "source").applyInPandasWithState(update, "series string, source string, en string, seq bigint, event string", "first string, mixed boolean, trusted bigint, held string", "append", GroupStateTimeout.NoTimeout)
