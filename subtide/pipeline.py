"""From videos to subtitles, in two ways: ``high`` (recognise, audit, translate, lay out, condense, report) and ``fast``
(the recogniser translates). All episodes go through one job graph; a store of Parquet tables makes a run resumable.

Paid calls (recogniser, translator) are cut off by a checkpoint, so that nothing asks twice, and what fails becomes a row
of the table ``failures``; other episodes go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide import clients, schema
from subtide.config import DEFAULT, EngineConfig
from subtide.functions import text as X
from subtide.operators import audit, condense, contracts, folds, layout, ordered, timeline
from subtide.operators import memory as M
from subtide.session import durable
from subtide.sources import files, sinks

KEYS = ["series", "episode"]
_SEGMENT = "series string, episode string, pos int, id bigint, start_ms bigint, end_ms bigint, text_zh string, words array<struct<start_ms:bigint,end_ms:bigint,word:string>>, recovered boolean"
TABLES = {
    "segments": _SEGMENT,
    "episodes": "series string, episode string, path string, size bigint, modified timestamp, model string, beam_size int, asr_audit struct<version:int,enabled:boolean>",
    "audits": "version int, enabled boolean, series string, episode string, original bigint, windows bigint, recovered bigint, merged bigint, rejected bigint, suspects bigint, large_gaps bigint",
    "translations": "series string, episode string, id bigint, signature string, en string",
    "translation_memory": "series string, source string, signature string, en string, seq bigint",
    "terms": "series string, source string, en string, status string, locked boolean, source_type string",
    "term_occurrences": "series string, episode string, cue string, source string, en string, context string, suspect boolean, seq bigint",
    "conflicts": "series string, source string, established string, alternative string, episode string, cue string",
    "condensation_cache": "series string, signature string, payload string, seq bigint",
    "failures": "series string, episode string, batch bigint, status string, reason string, seq bigint",
    "outputs": "series string, episode string",
}


@dataclass(frozen=True)
class Tools:
    """The clients. decode: path -> audio; the others make an instance per task."""

    decode: Callable[[str], bytes]
    recogniser: Callable[[], clients.Recogniser]
    voice: Callable[[], clients.VoiceActivity] | None = None
    translator: Callable[[], clients.Requester] | None = None
    shorten: Callable[..., str] | None = None
    verify: Callable[..., str] | None = None


@dataclass(frozen=True)
class Options:
    model: str = "medium"
    beam_size: int = 5
    style: str = "subtitle"
    version: str = "1"
    run: int = 1
    recovery: bool = True
    condense: bool = False
    srt_only: bool = False
    overwrite: bool = False
    secret: str = ""
    config: EngineConfig = field(default=DEFAULT)

    def __post_init__(self) -> None:
        if self.beam_size < 1 or self.config.batch_size < 1 or self.config.max_windows < 1:
            raise ValueError("beam size, batch size and the number of windows must be positive")


class Store:
    """Tables in a folder, each replaced as a whole; a missing one is empty. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], TABLES[name])
        self.spark.catalog.refreshByPath(path)
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def replace(self, name: str, df: DataFrame) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], TABLES[name]).schema]
        sinks.replace_table(self.spark, df.select(*columns), f"{self.folder}/{name}.parquet")

    def replace_episodes(self, name: str, rows: DataFrame, episodes: DataFrame) -> None:
        """The rows of these episodes anew; those of others stay."""
        self.replace(name, durable(self.read(name).join(episodes.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(rows, allowMissingColumns=True)))


def translation_signature(segments: DataFrame, entries: DataFrame, style: str, version: str) -> DataFrame:
    """``segments`` with signature: what their translation depends on besides their text. It is a column, so translations
    under an earlier signature stay as history."""
    keys = M.memory_keys(segments, entries, clients.prompt(style), version).withColumnsRenamed({"series": "__s", "text": "__t"})
    return segments.join(keys, F.col("series").eqNullSafe(F.col("__s")) & (F.col("text_zh") == F.col("__t")), "left").drop("__s", "__t")


def recognise(store: Store, todo: DataFrame, tools: Tools, options: Options) -> None:
    """Recognise what is new or has changed, and audit what was not audited yet in the way now asked for."""
    config = options.config
    stamped = todo.select(*KEYS, "path", "size", "modified", F.lit(options.model).alias("model"), F.lit(options.beam_size).alias("beam_size"))
    held = store.read("episodes")
    mark = lambda df: df.select(F.to_json(F.struct(*KEYS)).alias("key"), "path", "size", "modified", "model", "beam_size")
    changed = files.fingerprint_changes(mark(stamped), mark(held), "key").filter("state <> 'same'").select("key")
    fresh = durable(stamped.withColumn("key", F.to_json(F.struct(*KEYS))).join(changed, "key", "left_semi").drop("key"))
    raw = durable(clients.recognise_with(clients.decode_with(fresh, tools.decode), tools.recogniser))
    rows = folds.cleanup(timeline.sentence_split(raw), config).withColumns({"pos": F.col("id").cast("int"), "recovered": F.lit(False)})
    store.replace_episodes("segments", rows, fresh)
    store.replace_episodes("episodes", fresh, fresh)

    held = store.read("episodes")
    due = durable(audit.needs_audit(held.join(todo.select(*KEYS), KEYS, "left_semi"), options.recovery and tools.voice is not None, config))
    segments = store.read("segments").join(due.select(*KEYS), KEYS, "left_semi")
    audio = clients.decode_with(due, tools.decode)
    hear = (lambda windows: clients.transcribe_with(windows, audio, tools.recogniser)) if options.recovery and tools.voice else None
    speech = durable(clients.hear_with(audio, tools.voice)) if hear else store.spark.createDataFrame([], schema.SPEECH)
    audited, report = audit.audit(segments, speech, hear, config)
    audited = durable(ordered.plain(ordered.neighbours(audited, KEYS, ["start_ms", "id"], ["id"], timeline.HOUR_MS)).withColumn("pos", F.col("position").cast("int")).drop("before", "after", "position"))
    report = durable(report)
    store.replace_episodes("segments", audited, due)
    store.replace_episodes("audits", report, due)
    done = due.withColumn("asr_audit", F.struct(F.lit(config.audit_version).alias("version"), F.lit(hear is not None).alias("enabled")))
    store.replace_episodes("episodes", done, due)


def _requests(missing: DataFrame, segments: DataFrame, resolved: DataFrame, config: EngineConfig) -> DataFrame:
    """series, episode, batch, ids, targets, previous, following, glossary: one row per batch that lacks a translation. Batches
    are cut before what is known is left out, so that a resumed run asks as the first one did."""
    frames = timeline.context_frames(segments, KEYS, "pos", "text_zh", config)
    placed = timeline.batches(missing, "pos", config.batch_size)
    item = F.struct(F.col("pos").alias("pos"), F.col("id").alias("id"), F.col("text_zh").alias("zh"))
    grouped = placed.groupBy(*KEYS, "batch").agg(F.array_sort(F.collect_list(item)).alias("t"))  # at most one batch
    terms = resolved.groupBy("series", F.col("text").alias("text_zh")).agg(F.collect_set(F.struct("term", "en", "authority")).alias("g"))  # of one text
    pruned = placed.join(terms, ["series", "text_zh"]).groupBy(*KEYS, "batch").agg(F.array_distinct(F.flatten(F.collect_list("g"))).alias("glossary"))
    out = grouped.join(frames, [*KEYS, "batch"], "left").join(pruned, [*KEYS, "batch"], "left")
    return out.select(*KEYS, "batch", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["zh"]).alias("targets"), "previous", "following", F.to_json("glossary").alias("glossary"))


def translate(store: Store, segments: DataFrame, glossary: DataFrame, tools: Tools, options: Options) -> DataFrame:
    """The segments with en (null where it is missing still): resumed, remembered, or asked for; learns terms on the way."""
    config, run = options.config, F.lit(options.run).cast("bigint")
    entries = M.dictionary(glossary, store.read("terms"), M.candidate_counts(store.read("term_occurrences")))
    signed = durable(translation_signature(segments.filter("trim(text_zh) <> ''"), entries, options.style, options.version))
    resumed = signed.join(store.read("translations"), [*KEYS, "id", "signature"], "left")
    # What was translated before is held against the terms of today, and asked for again if it breaks one.
    broken = M.missing_terms(resumed.filter("en is not null").withColumn("__id", F.to_json(F.struct(*KEYS, "id"))), entries, "__id", "text_zh", "en").select("__id").distinct()
    resumed = resumed.withColumn("__id", F.to_json(F.struct(*KEYS, "id"))).join(broken.withColumn("__bad", F.lit(True)), "__id", "left").withColumn("en", F.when(F.col("__bad").isNull(), F.col("en"))).drop("__id", "__bad")
    targets = M.partition_hits(resumed.withColumn("source", X.nfkc(F.col("text_zh"))), store.read("translation_memory"))
    known = durable(targets.withColumn("en", F.coalesce("en", "memory_en")).drop("memory_en"))
    missing = known.filter("en is null")
    asked = _requests(missing, signed, M.resolve(missing, entries), config)
    replies = durable(clients.request_with(asked, tools.translator)) if tools.translator else asked.limit(0).select(*KEYS, "batch", F.lit("").alias("status"), F.lit("").alias("reason"), F.array().cast("array<struct<id:bigint,en:string>>").alias("items"))
    got = replies.filter("status = 'ok'").select(*KEYS, "batch", F.inline("items")).select(*KEYS, "batch", "id", F.trim("en").alias("fresh"))
    placed = missing.drop("en", "hit").join(got, [*KEYS, "id"]).withColumn("__id", F.to_json(F.struct(*KEYS, "batch")))
    refused = M.missing_terms(placed, entries, "__id", "text_zh", "fresh").select("__id").distinct()  # one bad answer refuses its batch
    accepted = durable(placed.join(refused, "__id", "left_anti").select(*KEYS, "id", "fresh"))
    failed = replies.filter("status <> 'ok'").select(*KEYS, "batch", "status", "reason").unionByName(placed.join(refused, "__id", "left_semi").select(*KEYS, "batch", F.lit("terms").alias("status"), F.lit("a bound term is missing").alias("reason")).distinct())
    store.replace("failures", durable(store.read("failures").unionByName(contracts.dead_letters(failed.withColumn("seq", run), options.secret))))

    out = durable(known.join(accepted, [*KEYS, "id"], "left").withColumn("en", F.coalesce("en", "fresh")).drop("fresh"))
    done = out.filter("en is not null")
    store.replace("translations", durable(M.upsert_latest(store.read("translations").withColumn("seq", F.lit(0).cast("bigint")), done.select(*KEYS, "id", "signature", "en", run.alias("seq")), [*KEYS, "id", "signature"])))
    store.replace("translation_memory", durable(M.upsert_latest(store.read("translation_memory"), done.select("series", "source", "signature", "en", run.alias("seq")).distinct(), ["series", "source", "signature"])))
    learn(store, done, options)
    return out


def learn(store: Store, done: DataFrame, options: Options) -> None:
    """Observe the entities of new translations; promote, and record what contradicts."""
    suspect = X.repeated_character(F.col("text_zh"))
    pairs = done.select(*KEYS, F.col("id").cast("string").alias("cue"), "text_zh", "en", X.entities_zh(F.col("text_zh")).alias("z"), X.entities_en(F.col("en")).alias("e"), suspect.alias("suspect"), "pos")
    seen = pairs.filter("size(z) = 1 and size(e) = 1").select(*KEYS, "cue", F.get("z", F.lit(0)).alias("source"), F.get("e", F.lit(0)).alias("en"), F.col("text_zh").alias("context"), "suspect", (F.lit(options.run * 10_000_000).cast("bigint") + F.col("pos")).alias("seq"))
    every = durable(M.insert_first(store.read("term_occurrences"), seen, [*KEYS, "cue", "source"]))
    store.replace("term_occurrences", every)
    observed = durable(M.observe(every, store.read("terms"), options.config))
    store.replace("terms", durable(store.read("terms").unionByName(M.promotions(observed))))
    store.replace("conflicts", durable(M.conflicts(observed)))


def high(spark: SparkSession, videos: DataFrame, glossary: DataFrame, store_folder: str, output: str, tools: Tools, options: Options | None = None) -> DataFrame:
    """series, episode, path, state ('done', 'skipped' or 'failed'), srt (its name) of every video.

    videos: series, episode, path, size, modified. Writes srt and qc below ``output``, and zh and segments unless ``srt_only``.
    An episode of which a segment has no translation is not written and counts as failed; what it has is kept.
    """
    options = options or Options()
    config, store = options.config, Store(spark, store_folder)
    todo = durable(files.without_outputs(videos, store.read("outputs"), KEYS, options.overwrite))
    recognise(store, todo, tools, options)
    segments = durable(store.read("segments").join(todo.select(*KEYS), KEYS, "left_semi"))
    if not options.srt_only:
        segments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).json(f"{output}/segments")
        sinks.write_srt(segments, f"{output}/zh", KEYS, "pos", "text_zh")
    translated = translate(store, segments, glossary, tools, options)
    final = durable(files.complete_episodes(translated, KEYS))
    cues = durable(layout.refine(final, glossary, config))
    if options.condense and tools.shorten and tools.verify:
        entries = M.dictionary(glossary, store.read("terms"))
        shorter = durable(condense.condense(final, cues, tools.shorten, tools.verify, entries, store.read("condensation_cache"), config, glossary, clients.prompt(options.style), options.version))
        store.replace("condensation_cache", durable(M.upsert_latest(store.read("condensation_cache"), condense.cache_entries(shorter, options.run), ["series", "signature"])))
        final = durable(condense.apply(final, shorter))
        cues = durable(layout.refine(final, glossary, config))
        counted = condense.outcome_counts(shorter)
        counted = counted.withColumnsRenamed({c: f"condensation_{c}" for c in counted.columns if c not in KEYS})
    lost = layout.failures(final, glossary, config)
    report = layout.qc_report(cues, lost, config)
    hits = final.groupBy(*KEYS).agg(F.count_if("hit").alias("translation_memory_hits"), F.count_if(~F.col("hit")).alias("translation_memory_misses"))
    report = report.join(hits, KEYS, "left").join(store.read("audits").drop("version", "enabled").withColumnsRenamed({"original": "asr_segments_original", "windows": "asr_recovery_windows", "recovered": "asr_segments_recovered", "rejected": "asr_recovery_rejected", "suspects": "asr_suspect_segments", "large_gaps": "asr_large_internal_word_gaps"}), KEYS, "left")
    if options.condense and tools.shorten and tools.verify:
        report = report.join(counted, KEYS, "left")
    sinks.write_srt(cues, f"{output}/srt", KEYS, "id")
    sinks.write_reports(report, f"{output}/qc", KEYS)
    store.replace("failures", durable(store.read("failures").unionByName(lost.select(*KEYS, F.col("id").cast("bigint").alias("batch"), F.lit("layout").alias("status"), F.col("problem").alias("reason"), F.lit(options.run).cast("bigint").alias("seq")))))
    return _summary(store, videos, todo, cues)


def fast(spark: SparkSession, videos: DataFrame, store_folder: str, output: str, tools: Tools, options: Options | None = None) -> DataFrame:
    """As ``high``, but the recogniser translates: no cleaning, memory, layout or report. Blank segments are left out."""
    options = options or Options(model="large-v3")
    store = Store(spark, store_folder)
    todo = durable(files.without_outputs(videos, store.read("outputs"), KEYS, options.overwrite))
    rows = durable(clients.recognise_with(clients.decode_with(todo, tools.decode), tools.recogniser, "translate"))
    cues = rows.filter("trim(text_zh) <> ''").select(*KEYS, F.col("pos").alias("id"), "start_ms", "end_ms", F.trim("text_zh").alias("text"))
    sinks.write_srt(cues, f"{output}/srt", KEYS, "id")
    return _summary(store, videos, todo, cues)


def _summary(store: Store, videos: DataFrame, todo: DataFrame, cues: DataFrame) -> DataFrame:
    written = durable(cues.select(*KEYS).distinct())
    store.replace("outputs", durable(store.read("outputs").unionByName(written).distinct()))
    done, open_ = written.withColumn("__done", F.lit(True)), todo.select(*KEYS).distinct().withColumn("__todo", F.lit(True))
    state = F.when(F.col("__todo").isNull(), "skipped").when(F.col("__done"), "done").otherwise("failed")
    return durable(videos.join(open_, KEYS, "left").join(done, KEYS, "left").select(*KEYS, "path", state.alias("state"), files.output_path(F.col("path"), ".en.srt").alias("srt")))


def exit_code(summary: DataFrame) -> int:
    """1 if any video failed."""
    return int(not summary.filter("state = 'failed'").isEmpty())


def state_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("state").agg(F.count("*").alias("n"))
