"""Parquet tables of a catalogue folder and the rule that the latest delivery of a row holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str | Sequence[str], order: str = "ingested_at") -> DataFrame:
    """One row per key: that with the greatest ``order``; among equals the one with the greatest row hash, so the choice
    does not depend on the plan. Rows in which a part of the key is null have no identity and are dropped. The row
    number filter becomes a group limit before the shuffle, so a key delivered very often is reduced map-side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), tie)
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def segments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current segments, reduced to ``columns`` (and seg_id) before the shuffle."""
    df = table(spark, folder, "segments")
    wanted = list(dict.fromkeys(["seg_id", *columns, "ingested_at"])) if columns else df.columns
    return latest(df.select(*wanted), "seg_id")


def cues(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = table(spark, folder, "cues")
    wanted = list(dict.fromkeys(["cue_id", *columns, "ingested_at"])) if columns else df.columns
    return latest(df.select(*wanted), "cue_id")


def valid_times(df: DataFrame) -> DataFrame:
    return df.filter("start_ms is not null and end_ms is not null and end_ms > start_ms")
