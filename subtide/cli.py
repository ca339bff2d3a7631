"""Command lines over the operators: terms, validate, refine. Each takes a session, so tests can call them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators import layout
from subtide.operators import memory as M
from subtide.session import durable, local_session
from subtide.sources import files, sinks


def terms(spark: SparkSession, store: str, command: str, series: str, source: str | None = None, en: str | None = None) -> DataFrame:
    """stats, list, search, candidates, conflicts, set, lock, unlock, delete, export of the store in folder ``store``."""
    path = f"{store}/terms.parquet"
    held = spark.read.parquet(path)
    own = held.filter(F.col("series") == series)
    if command in ("set", "lock", "unlock", "delete"):
        new = {"set": lambda: M.set_term(held, series, source, en), "lock": lambda: M.lock_term(held, series, source), "unlock": lambda: M.lock_term(held, series, source, False), "delete": lambda: M.delete_term(held, series, source)}[command]()
        sinks.replace_table(spark, new, path)
        spark.catalog.refreshByPath(path)
        return spark.read.parquet(path).filter(F.col("series") == series)
    if command == "list":
        return own
    if command == "search":
        return M.search(own, source or "")
    seen = spark.read.parquet(f"{store}/term_occurrences.parquet").filter(F.col("series") == series)
    candidates, found = M.candidate_counts(seen), M.conflicts(M.observe(seen, own))
    if command == "stats":
        return M.store_stats(terms=own, candidates=candidates, conflicts=found, occurrences=seen)
    if command == "candidates":
        return candidates
    if command == "conflicts":
        return found
    if command == "export":
        return M.export(own, candidates, found)
    raise ValueError(command)


def validate(spark: SparkSession, folder: str) -> int:
    """1 if a text can't be read or a cue is in error, 0 otherwise; warnings don't count."""
    cues = files.read_srt(spark, folder)
    found = layout.validate(cues.filter("problem is null"), ["path"], ["n"], "id")
    bad = cues.filter("problem is not null").limit(1).count() + found.filter("level = 'error'").limit(1).count()
    found.groupBy("path", "level", "problem").count().show(1000, False)
    return int(bad > 0)


def refine(spark: SparkSession, states: str, glossary: str, output: str, series: str) -> DataFrame:
    """Lay out the complete episodes of a folder of states anew; writes SRT texts and reports, and returns the reports."""
    rows = files.complete_episodes(files.state_segments(files.read_states(spark, states)), ["path"])
    rows = rows.select(F.lit(series).alias("series"), files.stem(F.col("path")).alias("episode"), "pos", "id", "start_ms", "end_ms", "words", "en")
    cues = durable(layout.refine(rows, files.read_glossary(spark, glossary, series)))
    reports = layout.qc_report(cues).join(layout.timing_drift(cues, rows).withColumnRenamed("ok", "timing_drift_check"), ["series", "episode"])
    sinks.write_srt(cues, f"{output}/srt", ["series", "episode"], "id")
    sinks.write_reports(reports, f"{output}/qc", ["series", "episode"])
    return reports


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="subtide")
    commands = parser.add_subparsers(dest="command", required=True)
    t = commands.add_parser("terms")
    for name in ("store", "action", "series"):
        t.add_argument(name)
    t.add_argument("source", nargs="?")
    t.add_argument("en", nargs="?")
    commands.add_parser("validate").add_argument("folder")
    r = commands.add_parser("refine")
    for name in ("states", "glossary", "output", "series"):
        r.add_argument(name)
    a = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if a.command == "validate":
        return validate(spark, a.folder)
    out = terms(spark, a.store, a.action, a.series, a.source, a.en) if a.command == "terms" else refine(spark, a.states, a.glossary, a.output, a.series)
    out.show(1000, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
