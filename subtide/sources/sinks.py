"""Sinks: SRT texts, reports, and tables that are replaced as a whole."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import text as X
from subtide.operators import ordered


#: So many cues are one part of an SRT text.
PART_CUES = 1000


def srt_texts(cues: DataFrame, keys: list[str], order: str, text: str = "text", renumber: bool = True) -> DataFrame:
    """keys, part, srt: the SRT text of each episode in parts of PART_CUES cues, in order; a newline joins two parts.

    Blank cues are left out before numbering. An episode of any length is never in one row.
    """
    rows = cues.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(*keys, F.col(order).alias("o"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col(text).alias("t"))
    rows = ordered.plain(ordered.neighbours(rows, keys, ["o", "s"], ["o"]))
    number = F.col("position") if renumber else F.col("o")
    block = F.concat(number.cast("string"), F.lit("\n"), X.time_text(F.col("s")), F.lit(" --> "), X.time_text(F.col("e")), F.lit("\n"), F.col("t"), F.lit("\n"))
    blocks = rows.select(*keys, F.floor((F.col("position") - 1) / PART_CUES).alias("part"), F.struct("position", block.alias("b")).alias("x"))
    return blocks.groupBy(*keys, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n").alias("srt"))


def write_srt(cues: DataFrame, path: str, keys: list[str], order: str, text: str = "text") -> None:
    """One SRT file per episode, below a folder per key; its parts are written one after the other."""
    parts = srt_texts(cues, keys, order, text).repartition(*keys).sortWithinPartitions(*keys, "part")
    parts.select(*keys, "srt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).option("lineSep", "\n").text(path)


def write_reports(reports: DataFrame, path: str, keys: list[str]) -> None:
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside the table, then swap by renaming: readers see the old rows or the new ones. One writer at a time."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    staged, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("staged", "old"))
    df.write.parquet(staged.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)


def json_safe(value: Any) -> Any:
    """JSON-native types only: array scalars and arrays, sets and paths are converted; anything else is an error."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value.item() if hasattr(value, "item") else value
    if isinstance(value, Mapping):
        return {k if isinstance(k, str) else str(json_safe(k)): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((json_safe(v) for v in value), key=str)
    if isinstance(value, Path):
        return str(value)
    if hasattr(value, "tolist"):
        return json_safe(value.tolist())
    raise TypeError(f"{type(value).__name__} has no JSON form")


def save_json(path: str | Path, data: Any) -> None:
    """A driver-side report, replaced atomically."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        staged.write_text(json.dumps(json_safe(data), ensure_ascii=False, indent=2), encoding="utf-8")
        os.replace(staged, target)
    finally:
        staged.unlink(missing_ok=True)
