"""Queries of the dictionary, the translation memory and the learning of terms, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide import clients
from subtide.functions import text as X
from subtide.functions.columns import big
from subtide.operators import memory as M
from subtide.plans.periods import LATEST
from subtide.sources import files, tables

KEYS = ["series", "episode"]


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: tables.table(spark, folder, name)
    observed = M.observe(t("term_occurrences"), t("terms"))
    return M.dictionary(t("glossary"), t("terms"), M.candidate_counts(t("term_occurrences")), None if observed is None else M.local_hints(observed).groupBy("series", "source").agg(F.max("en").alias("en")))


def _hard(spark: SparkSession, folder: str) -> DataFrame:
    return M.dictionary(tables.table(spark, folder, "glossary"), tables.table(spark, folder, "terms"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.segments(spark, folder, *KEYS, "text_zh")


def dictionary_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Every authority; of candidates the rarest rendering."""
    return _entries(spark, folder)


def dictionary_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Hard terms in each distinct text of a series, longest first."""
    return M.resolve(_texts(spark, folder), _hard(spark, folder)).select("series", "text", "term", "en", "authority")


def dictionary_trie(spark: SparkSession, folder: str) -> DataFrame:
    """J1 as for dictionaries too large for one pattern: the same rows as dictionary_resolve."""
    return M.resolve_by_trie(_texts(spark, folder), _hard(spark, folder)).select("series", "text", "term", "en", "authority")


def authority_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A3, X14."""
    texts = _texts(spark, folder)
    out = M.authority_counts(M.resolve(texts, _hard(spark, folder)), texts)
    return out.select("series", *[big(F.col(a)).alias(a) for a in M.AUTHORITIES])


def term_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Hard terms that a translation lacks, by longest match."""
    rows = tables.segments(spark, folder, "series", "text_zh", "en")
    return M.missing_terms(rows, _hard(spark, folder), "seg_id", "text_zh", "en")


def glossary_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary terms contained in the source and not in the English."""
    glossary = M.dictionary(tables.table(spark, folder, "glossary"), tables.table(spark, folder, "terms").limit(0))
    rows = tables.segments(spark, folder, "series", "text_zh", "en")
    return M.missing_terms(rows, glossary, "seg_id", "text_zh", "en", longest_match=False)


def memory_upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """U4: the latest row of each key."""
    return M.latest_by(tables.table(spark, folder, "translation_memory"), ["series", "source", "signature"]).select("seq", "series", "source", "signature", "en")


def memory_insert_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each occurrence."""
    return M.first_by(tables.table(spark, folder, "term_occurrences"), ["series", "episode", "cue", "source"]).select("seq", "series", "source", "en")


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    """Current segments, each with the signature under which the memory last kept its text (null if it never did)."""
    last = M.latest_by(tables.table(spark, folder, "translation_memory"), ["series", "source"]).select("series", "source", "signature")
    targets = tables.segments(spark, folder, "series", "text_zh").filter("text_zh is not null").withColumnRenamed("text_zh", "source")
    return targets.join(last, ["series", "source"], "left")


def memory_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Current segments whose text and signature the memory knows, and those that it doesn't."""
    return M.partition_hits(_targets(spark, folder), tables.table(spark, folder, "translation_memory")).select("seg_id", "signature", "hit", F.col("memory_en").alias("en"))


def hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    """A8."""
    out = M.hit_rate(M.partition_hits(_targets(spark, folder), tables.table(spark, folder, "translation_memory")))
    return out.select("series", big(F.col("hits")).alias("hits"), big(F.col("misses")).alias("misses"), big(F.col("percent")).alias("percent"))


def memory_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """F16: keys per series: how many distinct ones its texts have."""
    keys = M.memory_keys(_texts(spark, folder), _hard(spark, folder), "subtitle", "1")
    return keys.groupBy("series").agg(F.count("*").alias("texts"), F.count_distinct("signature").alias("signatures"))


def batch_with_client(spark: SparkSession, folder: str) -> DataFrame:
    """Hits from the memory, misses from a stub that translates by upper case; each distinct miss once."""
    known = memory_partition(spark, folder).drop("signature").join(tables.segments(spark, folder, "series", "text_zh"), "seg_id")
    misses = known.filter("not hit").filter(F.col("text_zh").rlike(r"(?U)\S")).select("series", F.col("text_zh").alias("source")).distinct()
    done = clients.translate_with(misses, clients.UpperTranslator).filter("status = 'ok'").select("series", F.col("source").alias("text_zh"), F.col("en").alias("fresh"))
    return known.join(done, ["series", "text_zh"], "left").select("seg_id", "hit", F.coalesce("en", "fresh").alias("en"))


def candidate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A4, A6, U6."""
    return M.candidate_counts(tables.table(spark, folder, "term_occurrences"))


def trusted_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, trusted occurrences and distinct renderings."""
    rows = M.first_by(tables.table(spark, folder, "term_occurrences"), ["series", "episode", "cue", "source"])
    return rows.groupBy("series", "source").agg(F.count_if(~F.coalesce("suspect", F.lit(False))).alias("trusted"), F.count_distinct("en").alias("renderings"))


def _observed(spark: SparkSession, folder: str, with_terms: bool) -> DataFrame:
    return M.observe(tables.table(spark, folder, "term_occurrences"), tables.table(spark, folder, "terms") if with_terms else None)


def term_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """Learnt from nothing."""
    return _observed(spark, folder, False).filter("promotes").select("series", "source", "en", "seq")


def term_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Renderings that contradict what was established."""
    return M.conflicts(_observed(spark, folder, True))


def local_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Learnt from nothing."""
    return M.local_hints(_observed(spark, folder, False))


def state_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of those episodes that are wholly translated, ten segments being an episode here."""
    rows = tables.segments(spark, folder, *KEYS, "pos", "en").withColumn("part", F.floor(F.col("pos") / 10))
    return files.complete_episodes(rows, [*KEYS, "part"]).select("seg_id")


def translation_version_history(spark: SparkSession, folder: str) -> DataFrame:
    """The first and the last translation of each source of the memory, side by side."""
    tm = tables.table(spark, folder, "translation_memory").filter("source is not null")
    rows = M.first_by(tm, ["series", "source"]).withColumn("signature", F.lit("first")).unionByName(M.latest_by(tm, ["series", "source"]).withColumn("signature", F.lit("last")))
    return M.compare_versions(rows, ["series", "source"], "first", "last")


def skip_existing(spark: SparkSession, folder: str) -> DataFrame:
    """Series and episodes with segments and without cues, and the other way round."""
    seg, cue = (tables.table(spark, folder, n).select(*KEYS).distinct() for n in ("segments", "cues"))
    return files.without_outputs(seg, cue, KEYS).withColumn("lacks", F.lit("cues")).unionByName(files.without_outputs(cue, seg, KEYS).withColumn("lacks", F.lit("segments")))


def fingerprint_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Segments against the same segments as first delivered."""
    raw = tables.table(spark, folder, "segments").select("seg_id", "start_ms", "end_ms", "text_zh", "ingested_at")
    first = M.first_by(raw, ["seg_id"], "ingested_at").drop("ingested_at")
    return files.fingerprint_changes(tables.latest(raw, "seg_id").drop("ingested_at"), first, "seg_id")


def term_search(spark: SparkSession, folder: str) -> DataFrame:
    """U10, U11."""
    return M.search(tables.table(spark, folder, "terms"), "s_al").select("term_id", "source", "en")


def store_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A13."""
    return M.store_stats(**{n: tables.table(spark, folder, n) for n in ("terms", "term_occurrences", "translation_memory", "glossary")})


def term_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Per series, locked terms after locking one, deleting one and setting one."""
    terms = tables.table(spark, folder, "terms").select("series", "source", "en", "status", "locked", "source_type")
    pick = "chichi-chronicle"
    edited = M.set_term(M.delete_term(M.lock_term(terms, pick, "溟岚珞莲"), pick, "没有"), pick, "新词", "New Word")
    return edited.groupBy("series").agg(F.count("*").alias("terms"), F.count_if("locked").alias("locked"))


def store_export(spark: SparkSession, folder: str) -> DataFrame:
    """K8."""
    t = tables.table(spark, folder, "terms").select("series", "source", "en", "status", "locked", "source_type")
    return M.export(t, candidate_counts(spark, folder), term_conflicts(spark, folder))


_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, episode, cue, source ORDER BY seq) AS rn FROM term_occurrences) WHERE rn = 1)"
_LEARN = _FIRST + """,
r AS (SELECT *, first_value(en) OVER o AS fe, sum(CASE WHEN coalesce(suspect, false) THEN 0 ELSE 1 END) OVER (PARTITION BY series, source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS trusted FROM first WINDOW o AS (PARTITION BY series, source ORDER BY seq)),
k AS (SELECT *, sum(CASE WHEN en IS DISTINCT FROM fe THEN 1 ELSE 0 END) OVER (PARTITION BY series, source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS other FROM r),
a AS (SELECT series, source, any_value(fe) AS fe, min(seq) AS at_seq FROM k WHERE trusted >= 3 AND other = 0 AND fe IS NOT NULL GROUP BY ALL)"""
_TM_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, source ORDER BY seq DESC) AS rn FROM translation_memory) WHERE rn = 1)"
_PART = f"""WITH {LATEST}, {_TM_LAST},
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, source, signature ORDER BY seq DESC) AS rn FROM translation_memory) WHERE rn = 1 AND en IS NOT NULL),
t AS (SELECT seg.seg_id, seg.series, seg.text_zh, last.signature FROM seg LEFT JOIN last ON seg.series = last.series AND seg.text_zh = last.source WHERE seg.text_zh IS NOT NULL),
p AS (SELECT t.*, held.en FROM t LEFT JOIN held ON t.series = held.series AND t.text_zh = held.source AND t.signature = held.signature)"""
#: SQL: letters that count as a part of a word beside ASCII ones.
_ACCENTED = r"[\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{3400}-\x{9FFF}]"
#: SQL: a text as it is matched: width and compatibility forms unified as far as the tables hold any, ends trimmed.
_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _nfkc(column: str) -> str:
    spaces = "'　' || chr(160) || chr(8239) || chr(8201) || chr(8194)"
    return f"regexp_replace(nfc_normalize(translate(translate({column}, '{_WIDE}', '{_NARROW}'), {spaces}, '     ')), '^\\s+|\\s+$', '', 'g')"


_RULED = f"""g AS (SELECT series, {_nfkc("source")} AS source, en, 'manual' AS authority, 1 AS rank, CASE WHEN section = 'terms' THEN 0 ELSE 1 END AS tie FROM glossary
  UNION ALL SELECT series, source, en, CASE WHEN coalesce(locked, false) THEN 'locked' ELSE 'confirmed' END, CASE WHEN coalesce(locked, false) THEN 2 ELSE 3 END, 0 FROM terms WHERE status IN ('confirmed', 'manual') OR coalesce(locked, false)"""
_BEST = "d AS (SELECT series, source, en, authority FROM (SELECT *, row_number() OVER (PARTITION BY series, source ORDER BY rank, tie, en) AS rn FROM g WHERE source <> '' AND en IS NOT NULL) WHERE rn = 1)"
_FOUND = f"""WITH {LATEST}, {_RULED}), {_BEST},
pat AS (SELECT series, string_agg(regexp_escape(source), '|' ORDER BY length(source) DESC, source) AS pattern FROM d GROUP BY series),
x AS (SELECT DISTINCT series, text_zh AS text FROM seg WHERE text_zh IS NOT NULL),
h AS (SELECT DISTINCT x.series, x.text, unnest(regexp_extract_all({_nfkc("x.text")}, pattern)) AS term FROM x JOIN pat ON x.series = pat.series),
f AS (SELECT h.*, d.en, d.authority FROM h JOIN d ON h.series = d.series AND h.term = d.source)"""

SQL = {
    "glossary_constraints": f"""WITH {LATEST}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, source ORDER BY section DESC) AS rn FROM (SELECT series, section, trim(nfc_normalize(source)) AS source, en FROM glossary)) WHERE rn = 1 AND source <> '' AND en IS NOT NULL)
SELECT seg_id, d.source AS term, d.en AS expected FROM seg JOIN d ON seg.series = d.series AND contains(seg.text_zh, d.source) WHERE seg.en IS NOT NULL AND NOT contains(seg.en, d.en)""",
    "dictionary_merge": f"""WITH {_LEARN}, last_term AS (SELECT series, source, en FROM (SELECT *, row_number() OVER (PARTITION BY series, source ORDER BY term_id DESC) AS rn FROM terms) WHERE rn = 1 AND en IS NOT NULL),
o AS (SELECT k.*, row_number() OVER (PARTITION BY k.series, k.episode, k.source ORDER BY k.seq DESC) AS n FROM k LEFT JOIN last_term t ON k.series = t.series AND k.source = t.source LEFT JOIN a ON k.series = a.series AND k.source = a.source
  WHERE t.en IS NULL AND (a.at_seq IS NULL OR k.seq <= a.at_seq) AND NOT coalesce(suspect, false) AND k.en IS NOT NULL),
{_RULED} UNION ALL SELECT series, source, max(en), 'local', 4, 0 FROM o WHERE n = 1 GROUP BY series, source UNION ALL SELECT series, source, en, 'candidate', 5, count(*) FROM first GROUP BY series, source, en), {_BEST} SELECT * FROM d""",
    "dictionary_resolve": _FOUND + " SELECT * FROM f",
    "dictionary_trie": _FOUND + " SELECT * FROM f",
    "authority_summary": _FOUND + ", n AS (SELECT series, text_zh AS text, count(*) AS rows FROM seg WHERE text_zh IS NOT NULL GROUP BY ALL) SELECT f.series, " + ", ".join(f"CAST(coalesce(sum(rows) FILTER (authority = '{a}'), 0) AS BIGINT) AS {a}" for a in M.AUTHORITIES) + " FROM f JOIN n ON f.series = n.series AND f.text = n.text GROUP BY f.series",
    "term_constraints": _FOUND + " SELECT seg_id, term, f.en AS expected FROM seg JOIN f ON seg.series = f.series AND seg.text_zh = f.text WHERE seg.en IS NOT NULL AND NOT contains(seg.en, f.en)",
    "memory_signatures": _FOUND + ", m AS (SELECT series, text, string_agg(term || '=' || en, chr(1) ORDER BY term || '=' || en) AS m FROM f GROUP BY series, text) SELECT x.series, count(*) AS texts, count(DISTINCT coalesce(m, '')) AS signatures FROM x LEFT JOIN m ON x.series = m.series AND x.text = m.text GROUP BY x.series",
    "entity_pairs": f"""WITH {LATEST}, e AS (SELECT seg_id, list_distinct(regexp_extract_all(text_zh, '[\\x{{4E00}}-\\x{{9FFF}}]{{1,8}}(?:{'|'.join(X.ENTITY_SUFFIXES)})')) AS z, list_distinct(regexp_extract_all(regexp_replace(en, '{_ACCENTED}', '0', 'g'), '\\b[A-Z][a-z]+(?:[- ][A-Z][a-z]+){{1,7}}\\b')) AS e FROM seg WHERE text_zh IS NOT NULL AND en IS NOT NULL)
SELECT seg_id, z[1] AS source_term, e[1] AS en_term FROM e WHERE len(z) = 1 AND len(e) = 1""",
    "term_edits": """WITH l AS (SELECT series, source, CASE WHEN series = 'chichi-chronicle' AND source = '溟岚珞莲' THEN true ELSE locked END AS locked FROM terms WHERE NOT (coalesce(series = 'chichi-chronicle', false) AND coalesce(source IN ('没有', '新词'), false)) UNION ALL SELECT 'chichi-chronicle', '新词', true)
SELECT series, count(*) AS terms, count(*) FILTER (locked) AS locked FROM l GROUP BY series""",
    "memory_upsert_latest": "SELECT seq, series, source, signature, en FROM (SELECT *, row_number() OVER (PARTITION BY series, source, signature ORDER BY seq DESC) AS rn FROM translation_memory) WHERE rn = 1",
    "memory_insert_first": f"WITH {_FIRST} SELECT seq, series, source, en FROM first",
    "memory_partition": _PART + " SELECT seg_id, signature, en IS NOT NULL AS hit, en FROM p",
    "hit_rate": _PART + " SELECT series, count(en) AS hits, count(*) - count(en) AS misses, count(en) * 100 // count(*) AS percent FROM p GROUP BY series",
    "batch_with_client": _PART + " SELECT seg_id, en IS NOT NULL AS hit, coalesce(en, CASE WHEN trim(text_zh, ' ' || chr(10) || chr(9) || chr(160) || chr(12288)) <> '' THEN upper(text_zh) END) AS en FROM p",
    "candidate_counts": f"WITH {_FIRST} SELECT series, source, en, count(*) AS n FROM first GROUP BY ALL",
    "trusted_counts": f"WITH {_FIRST} SELECT series, source, count(*) FILTER (NOT coalesce(suspect, false)) AS trusted, count(DISTINCT en) AS renderings FROM first GROUP BY ALL",
    "term_promotion": f"WITH {_LEARN} SELECT series, source, fe AS en, at_seq AS seq FROM a",
    "term_conflicts": f"""WITH {_LEARN}, t AS (SELECT series, source, en FROM terms WHERE en IS NOT NULL),
x AS (SELECT k.*, coalesce(t.en, CASE WHEN k.seq > a.at_seq THEN a.fe END) AS established FROM k LEFT JOIN t ON k.series = t.series AND k.source = t.source LEFT JOIN a ON k.series = a.series AND k.source = a.source)
SELECT DISTINCT series, source, established, en AS alternative, episode, cue FROM x WHERE established IS NOT NULL AND en IS DISTINCT FROM established""",
    "local_hints": f"""WITH {_LEARN}, x AS (SELECT k.*, row_number() OVER (PARTITION BY k.series, k.episode, k.source ORDER BY k.seq DESC) AS n FROM k LEFT JOIN a ON k.series = a.series AND k.source = a.source WHERE (a.at_seq IS NULL OR k.seq <= a.at_seq) AND NOT coalesce(suspect, false) AND en IS NOT NULL)
SELECT series, episode, source, en FROM x WHERE n = 1""",
    "state_completeness": f"WITH {LATEST}, x AS (SELECT *, bool_and(en IS NOT NULL) OVER (PARTITION BY series, episode, pos // 10) AS ok FROM seg) SELECT seg_id FROM x WHERE ok",
    "translation_version_history": f"WITH tm AS (SELECT * FROM translation_memory WHERE source IS NOT NULL) SELECT series, source, arg_min_null(en, seq) AS a, arg_max_null(en, seq) AS b, arg_min_null(en, seq) IS NOT DISTINCT FROM arg_max_null(en, seq) AS same FROM tm GROUP BY ALL",
    "skip_existing": "(SELECT DISTINCT series, episode, 'cues' AS lacks FROM segments WHERE (series, episode) NOT IN (SELECT series, episode FROM cues)) UNION ALL (SELECT DISTINCT series, episode, 'segments' FROM cues WHERE (series, episode) NOT IN (SELECT series, episode FROM segments))",
    "fingerprint_diff": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at) AS a, row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) AS z FROM segments)
SELECT n.seg_id, CASE WHEN n.start_ms IS NOT DISTINCT FROM o.start_ms AND n.end_ms IS NOT DISTINCT FROM o.end_ms AND n.text_zh IS NOT DISTINCT FROM o.text_zh THEN 'same' ELSE 'changed' END AS state FROM x n JOIN x o ON n.seg_id = o.seg_id WHERE n.z = 1 AND o.a = 1""",
    "term_search": "SELECT term_id, source, en FROM terms WHERE source ILIKE '%s_al%' OR en ILIKE '%s_al%'",
    "store_stats": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("terms", "term_occurrences", "translation_memory", "glossary")),
}
QUERIES = {
    f.__name__: f
    for f in (
        dictionary_merge, dictionary_resolve, dictionary_trie, authority_summary, term_constraints, glossary_constraints, memory_upsert_latest, memory_insert_first, memory_partition, hit_rate, memory_signatures, batch_with_client, candidate_counts,
        trusted_counts, term_promotion, term_conflicts, local_hints, state_completeness, translation_version_history, skip_existing, fingerprint_diff, term_search, store_stats, term_edits, store_export,
    )
}
