"""Files as sources: videos, SRT texts, episode states, glossaries; and the listing rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide import schema
from subtide.functions import text as X

VIDEO_EXTENSIONS = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v")
BOM = "﻿"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def natural_order(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with rank: names in natural order, equal ones by path."""
    keyed = paths.withColumn("__key", X.natural_key(base_name(F.col(path))))
    return keyed.orderBy("__key", path)


def from_episode(paths: DataFrame, first: int, path: str = "path") -> DataFrame:
    """Files whose name holds a number and whose last number is at least ``first``."""
    return paths.filter(F.coalesce(X.last_number(stem(F.col(path))) >= first, F.lit(False)))


def videos(spark: SparkSession, folder: str, first_episode: int | None = None, limit: int | None = None) -> DataFrame:
    """path, size, modified of the videos below a folder, in natural order; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(F.concat(F.lit("."), F.element_at(F.split(F.lower("path"), r"\."), -1)).isin(*VIDEO_EXTENSIONS))
    if first_episode is not None:
        found = from_episode(found, first_episode)
    found = natural_order(found).drop("__key")
    return found if limit is None else found.limit(limit)


def without_outputs(inputs: DataFrame, outputs: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    return inputs if overwrite else inputs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def fingerprint_changes(current: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """key, state: 'new', 'changed' or 'same', by a null-safe comparison of every other column."""
    columns = [c for c in current.columns if c != key]
    now, then = F.struct(*columns), F.struct(*columns)
    joined = current.select(key, now.alias("now")).join(stored.select(key, then.alias("then")), key, "left")
    return joined.select(key, F.when(F.col("then").isNull(), "new").when(F.col("now").eqNullSafe(F.col("then")), "same").otherwise("changed").alias("state"))


def output_path(path: Column, suffix: str) -> Column:
    """.en.srt -> another suffix beside it."""
    return F.concat(F.regexp_replace(path, r"(\.en)?\.[^./]*$", ""), F.lit(suffix))


_TIMES = r"^(\d{2,}:\d{2}:\d{2},\d{3}) --> (\d{2,}:\d{2}:\d{2},\d{3})$"


def parse_srt(texts: DataFrame, keys: list[str], text: str = "text", strict: bool = False) -> DataFrame:
    """keys, n (place in the file), id, start_ms, end_ms, text, problem: the cues of whole SRT texts.

    Blocks are parted by blank lines; a byte order mark and carriage returns are ignored. A block of fewer than three
    lines, without a number or with a malformed time line has a problem; ``strict`` raises on it.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), f"^{BOM}", ""), "\r\n?", "\n"))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    blocks = texts.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(F.filter(F.split(body, r"\n[ \t]*\n\s*"), lambda b: b != "")).alias("__n", "__b"))
    lines = blocks.withColumn("__l", F.split("__b", "\n"))
    time = F.trim(F.get("__l", F.lit(1)))
    problem = F.when(F.size("__l") < 3, "lines").when(~F.trim(F.get("__l", F.lit(0))).rlike(r"^\d+$"), "number").when(~time.rlike(_TIMES), "time")
    out = lines.select(
        *keys, (F.col("__n") + 1).cast("bigint").alias("n"), F.trim(F.get("__l", F.lit(0))).try_cast("bigint").alias("id"), X.time_ms(F.regexp_extract(time, _TIMES, 1)).alias("start_ms"),
        X.time_ms(F.regexp_extract(time, _TIMES, 2)).alias("end_ms"), F.array_join(F.slice("__l", F.lit(3), F.greatest(F.lit(0), F.size("__l") - 2)), "\n").alias("text"), problem.alias("problem"),
    )
    if strict:
        out = out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("malformed SRT block: "), F.col("problem"))).cast("string")))
    return out


def read_srt(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.srt").text(folder, wholetext=True)
    return parse_srt(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), ["path"], strict=strict)


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """path and the state document of each episode; an unreadable document has null fields."""
    files = spark.read.schema(schema.STATE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), "*")


def state_segments(states: DataFrame) -> DataFrame:
    """path, pos, the segment's fields and en: the translation under the segment's id; a missing one is null."""
    rows = states.select("path", "translations", F.posexplode("segments").alias("__p", "s"))
    return rows.select("path", (F.col("__p") + 1).alias("pos"), "s.*", F.try_element_at("translations", F.col("s.id").cast("string")).alias("en"))


def complete_episodes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of those episodes of which every segment is translated."""
    done = rows.groupBy(*keys).agg(F.bool_and(F.col("en").isNotNull()).alias("__ok")).filter("__ok").select(*keys)
    return rows.join(done, keys, "left_semi")


def read_glossary(spark: SparkSession, path: str, series: str) -> DataFrame:
    """series, section, source, en; a file without both sections is an error."""
    doc = spark.read.schema(schema.GLOSSARY_FILE).option("multiLine", True).json(path)
    checked = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"the glossary has no section {c}")).cast("map<string,string>")).otherwise(F.col(c))
    both = doc.select(F.map_from_arrays(F.array(F.lit("characters"), F.lit("terms")), F.array(checked("characters"), checked("terms"))).alias("m"))
    return both.select(F.explode("m").alias("section", "d")).select("section", F.explode("d").alias("source", "en")).select(F.lit(series).alias("series"), "section", "source", "en")
