"""Queries of text measures, line layout, contracts and files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import text as X
from subtide.functions.columns import big
from subtide.operators import condense, contracts, layout
from subtide.operators import memory as M
from subtide.plans.periods import LATEST
from subtide.plans.timeline import ISLANDS
from subtide.session import durable
from subtide.sources import files, sinks, tables

KEYS = ["series", "episode"]


def _segments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tables.segments(spark, folder, *KEYS, *columns)


def _cues(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tables.cues(spark, folder, *KEYS, *columns)


def visible_and_rate(spark: SparkSession, folder: str) -> DataFrame:
    """F4, F11."""
    rows = tables.valid_times(_cues(spark, folder, "start_ms", "end_ms", "text")).filter("text is not null")
    return rows.select("cue_id", big(X.visible(F.col("text"))).alias("visible"), big(F.floor(X.visible(F.col("text")) * 1_000_000 / (F.col("end_ms") - F.col("start_ms")))).alias("rate"))


def time_texts(spark: SparkSession, folder: str) -> DataFrame:
    """a time as text, and back."""
    rows = _cues(spark, folder, "start_ms").filter("start_ms is not null").select("cue_id", X.time_text(F.col("start_ms")).alias("t"))
    return rows.select("cue_id", "t", X.time_ms(F.col("t")).alias("ms"))


def numbers_found(spark: SparkSession, folder: str) -> DataFrame:
    """F12."""
    docs = tables.table(spark, folder, "documents").filter("text is not null")
    return docs.select("doc_id", F.explode(X.numbers(F.col("text"))).alias("number"))


def numbers_lost(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of a cue that its segment's translation lacks, and P15's join on the source."""
    seg = _segments(spark, folder, "id", "en").select(*KEYS, F.col("id").alias("source_id"), "en")
    both = _cues(spark, folder, "source_id", "text").join(seg, [*KEYS, "source_id"])
    return both.select("cue_id", F.explode(F.array_except(X.numbers(F.col("text")), X.numbers(F.coalesce("en", F.lit(""))))).alias("number"))


def han_share(spark: SparkSession, folder: str) -> DataFrame:
    """F13."""
    return tables.segments(spark, folder, "text_zh").filter("text_zh is not null").select("seg_id", big(X.han(F.col("text_zh"))).alias("han"), big(F.length("text_zh")).alias("n"))


def phrase_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A2 over the cues of each series."""
    counted = X.phrase_counts(F.col("text"))
    names = [p.lower().replace(" ", "_") for p in X.TRANSLATIONESE]
    return _cues(spark, folder, "text").groupBy("series").agg(*[F.sum(counted[n]).alias(n) for n in names])


def entity_extract(spark: SparkSession, folder: str) -> DataFrame:
    """F14."""
    rows = tables.segments(spark, folder, "text_zh").filter("text_zh is not null")
    return rows.select("seg_id", F.explode(X.entities_zh(F.col("text_zh"))).alias("entity"))


def entity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """F14, F15."""
    return M.entity_pairs(tables.segments(spark, folder, "text_zh", "en").filter("text_zh is not null and en is not null"), "seg_id", "text_zh", "en")


def wrap_two_lines(spark: SparkSession, folder: str) -> DataFrame:
    """F6, F7, O4 over the words of each translation; null where two lines can't hold it."""
    rows = tables.segments(spark, folder, "en").filter("en is not null").select("seg_id", X.squeeze(F.col("en")).alias("t")).filter("length(t) >= 1")
    return rows.select("seg_id", X.wrap_lines(F.split("t", " ")).alias("lines"))


def legacy_format(spark: SparkSession, folder: str) -> DataFrame:
    """every translation, with the character names of the series' glossary kept together."""
    rows = layout.with_names(tables.segments(spark, folder, "series", "en").filter("en is not null"), tables.table(spark, folder, "glossary").filter("section = 'characters'"))
    return rows.select("seg_id", X.balance_lines(F.col("en"), F.coalesce("names", F.array().cast("array<string>"))).alias("lines"))


def layout_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """words with the names of the series' glossary kept together."""
    rows = layout.with_names(tables.segments(spark, folder, "series", "en").filter("en is not null"), tables.table(spark, folder, "glossary"))
    return rows.select("seg_id", F.translate(F.array_join(X.layout_words(F.col("en"), F.col("names")), "|"), X.NBSP, " ").alias("words"))


def split_text(spark: SparkSession, folder: str) -> DataFrame:
    """F8: parts of each translation within its time."""
    rows = tables.valid_times(tables.segments(spark, folder, "start_ms", "end_ms", "en")).filter("trim(en) <> ''")
    return rows.select("seg_id", F.posexplode(layout.split_text(F.col("en"), F.col("end_ms") - F.col("start_ms"))).alias("part", "text"))


def _refined(spark: SparkSession, folder: str) -> DataFrame:
    return layout.refine(_segments(spark, folder, "pos", "id", "start_ms", "end_ms", "words", "en", "text_zh", "avg_logprob", "no_speech_prob"), tables.table(spark, folder, "glossary"))


def refine_cues(spark: SparkSession, folder: str) -> DataFrame:
    """W19 with W6 to W10 and W18: the cues of every episode, laid out anew."""
    return _refined(spark, folder).select(*KEYS, "id", "source_id", "start_ms", "end_ms", "text", "fixed")


def refine_single(spark: SparkSession, folder: str) -> DataFrame:
    """W19's times: W6, W7, W18, F10, F22 for every translated segment, with its words, in the order of pos."""
    seg = _segments(spark, folder, "pos", "id", "start_ms", "end_ms", "words", "en")
    return layout.speech_times(seg.filter("trim(en) <> ''")).filter("not timing_error").select("seg_id", "cue_start_ms", "cue_end_ms", "anomaly", "island_split", "fallback_capped")


def qc_report(spark: SparkSession, folder: str) -> DataFrame:
    """W19, A1, A2, A11, A12 as one row an episode."""
    return layout.qc_report(durable(_refined(spark, folder)))


def timing_drift(spark: SparkSession, folder: str) -> DataFrame:
    """P15 on the stored cues."""
    return layout.timing_drift(tables.valid_times(_cues(spark, folder, "source_id", "start_ms", "end_ms")), tables.valid_times(_segments(spark, folder, "id", "start_ms", "end_ms")))


def cue_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A1 on the stored cues."""
    out = layout.metrics(tables.valid_times(_cues(spark, folder, "id", "start_ms", "end_ms", "text")), KEYS, ["id", "cue_id"])
    return out.select(*KEYS, *[(F.col(c).cast("double") if c == "median_cps" else big(F.col(c))).alias(c) for c in out.columns if c not in KEYS])


def cue_validate(spark: SparkSession, folder: str) -> DataFrame:
    """P14 on the stored cues."""
    return layout.validate(_cues(spark, folder, "id", "start_ms", "end_ms", "text"), KEYS, ["id", "cue_id"], "cue_id").select("cue_id", "level", "problem")


def awkward_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """W17 on the stored cues."""
    return layout.awkward_boundaries(_cues(spark, folder, "id", "text"), KEYS, ["id", "cue_id"], "cue_id").select("cue_id")


def rate_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """P14's warning about the rate of a whole episode, on the stored cues."""
    out = layout.rate_warnings(tables.valid_times(_cues(spark, folder, "start_ms", "end_ms", "text")), KEYS)
    return out.select(*KEYS, big(F.col("over_20")).alias("over_20"), big(F.col("over_25")).alias("over_25"))


def layout_failures(spark: SparkSession, folder: str) -> DataFrame:
    """K9: translated segments that no cue can show, and why."""
    return layout.failures(_segments(spark, folder, "pos", "id", "start_ms", "end_ms", "words", "en"), tables.table(spark, folder, "glossary"))


def example_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Per episode the first segment that is long in text or time, else the first."""
    rows = _segments(spark, folder, "pos", "start_ms", "end_ms", "en")
    long = (F.length(F.coalesce("en", F.lit(""))) > 84) | (F.col("end_ms") - F.col("start_ms") > 6000)
    best = rows.groupBy(*KEYS).agg(F.min(F.struct(F.when(F.coalesce(long, F.lit(False)), 0).otherwise(1).alias("late"), "pos", "seg_id")).alias("m"))
    return best.select(*KEYS, "m.seg_id")


def srt_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cues written as SRT texts and read back."""
    rows = tables.valid_times(_cues(spark, folder, "id", "start_ms", "end_ms", "text"))
    clean = rows.withColumn("text", F.trim(F.regexp_replace("text", r"\s*\n\s*", "\n")))
    return files.parse_srt(sinks.srt_texts(clean, KEYS, "id"), [*KEYS, "part"], "srt").select(*KEYS, "id", "start_ms", "end_ms", "text")


def natural_order(spark: SparkSession, folder: str) -> DataFrame:
    """Episode names in natural order, those from number 3 on; the key as text."""
    names = _segments(spark, folder).select("episode").distinct()
    kept = files.from_episode(names, 3, "episode")
    return kept.select("episode", F.array_join(X.natural_key(F.col("episode")), "|").alias("key"))


def response_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Replies made of the translations of each batch, some broken on purpose."""
    rows = _segments(spark, folder, "pos", "id", "en").withColumn("batch", F.floor((F.col("pos") - 1) / 10))
    item = F.struct(F.col("id").cast("bigint").alias("id"), "en")
    batch = rows.groupBy(*KEYS, "batch").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("x"))  # ten rows
    ids, items = F.transform("x", lambda r: r["item"]["id"]), F.transform("x", lambda r: r["item"])
    content = F.when(F.col("batch") % 3 == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(items.alias("translations"))), F.lit("\n```"))).when(F.col("batch") % 3 == 2, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("translations"))))
    raw = F.concat(F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))), F.lit("\ndata: [DONE]"))
    parsed = batch.select(*KEYS, "batch", ids.alias("ids"), contracts.parse_completion(raw).alias("c"))
    checked = parsed.select(*KEYS, "batch", contracts.validate_reply(F.col("c.content"), F.col("ids")).alias("r"))
    return checked.groupBy(F.col("r.status").alias("status"), F.coalesce("r.reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def risk_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Each cue as a shorter form of its segment's translation."""
    seg = _segments(spark, folder, "id", "text_zh", "en").filter("text_zh is not null and en is not null").select(*KEYS, F.col("id").alias("source_id"), "text_zh", "en")
    both = _cues(spark, folder, "source_id", "text").filter("text is not null").join(seg, [*KEYS, "source_id"])
    return both.select("cue_id", F.concat_ws(",", condense.risk_reasons(F.col("text_zh"), F.col("en"), F.col("text"))).alias("reasons"))


def severe_sources(spark: SparkSession, folder: str) -> DataFrame:
    """P13, A14."""
    rows = tables.valid_times(_cues(spark, folder, "source_id", "start_ms", "end_ms", "text")).filter("source_id is not null")
    return condense.severe_sources(rows).join(condense.source_durations(rows), [*KEYS, "source_id"])


def condense_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """X2, A15 with stubs: generation drops the last two words, verification accepts what keeps half."""
    seg = _segments(spark, folder, "pos", "id", "start_ms", "end_ms", "words", "text_zh", "en").filter("en is not null and text_zh is not null")
    cue = tables.valid_times(_cues(spark, folder, "source_id", "start_ms", "end_ms", "text")).filter("source_id is not null and text is not null")
    entries = M.dictionary(tables.table(spark, folder, "glossary"), tables.table(spark, folder, "terms"))
    done = condense.condense(seg, cue, lambda _s, old, *_: " ".join(old.split()[:-2]), lambda _s, old, new, *_: "ACCEPT" if len(new) * 2 > len(old) else "REJECT", entries)
    return condense.outcome_counts(done)


_V = r"length(regexp_replace({0}, '[\s\x{{A0}}\x{{3000}}\x{{2002}}\x{{2009}}\x{{202F}}]', '', 'g'))"
_NUM = r"regexp_extract_all({0}, '\d+(?:\.\d+)?')"
_BARE = r"""regexp_replace(lower({0}), '^[".,;:!?]+|[".,;:!?]+$', '', 'g')"""
_AVOID = ", ".join(f"'{w}'" for w in X.LINE_END_AVOID)
_GOOD = ", ".join(f"'{w}'" for w in X.LINE_START_GOOD)


#: SQL: letters that count as a part of a word beside ASCII ones.
_ACCENTED = r"[\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{3400}-\x{9FFF}]"


def _cuts(score: str, keep: str) -> str:
    return f"""
w AS (SELECT seg_id, t, string_split(t, ' ') AS ws FROM r),
c AS (SELECT seg_id, t, ws, unnest(range(1, len(ws))) AS i FROM w),
s AS (SELECT seg_id, ws[i] AS a, ws[i + 1] AS b, array_to_string(ws[1:i], ' ') AS l, array_to_string(ws[i + 1:], ' ') AS rr FROM c),
p AS (SELECT *, {score} AS score FROM s WHERE {keep}),
best AS (SELECT seg_id, l || chr(10) || rr AS two FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY score, l, rr) AS rn FROM p) WHERE rn = 1)"""


_PENALTY = f"""CASE WHEN {_BARE.format("a")} IN ({_AVOID}) OR {_BARE.format("a")} LIKE '%''s' THEN 150 WHEN regexp_matches(a, '[.!?]$') THEN -20 WHEN regexp_matches(a, '[,;:]$') THEN -10
  WHEN lower(b) IN ({_GOOD}) THEN -8 WHEN lower(a) = 'so' THEN 100 ELSE 0 END"""
_SQUEEZE = r"trim(regexp_replace(en, '[\s\x{A0}\x{3000}]+', ' ', 'g'))"
_SHORT = "CASE WHEN least(length(l), length(rr)) < 8 THEN 100 ELSE 0 END"
_RATE = "CAST(floor(" + _V.format("text") + " * 1000000 / greatest(1, end_ms - start_ms)) AS BIGINT)"
_HAS = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"

#: SQL: t (seg_id, t, es: what is kept together) -> tok (seg_id, dur, ws: the words that are laid out).
_TOKENS = """kept AS (SELECT seg_id, dur, t, list_transform(list_sort(list_transform(es, lambda x: struct_pack(n := -length(x), x := x))), lambda y: y.x) AS es FROM e),
tok AS (SELECT seg_id, dur, string_split(list_reduce(es, lambda acc, x: replace(acc, x, replace(x, ' ', chr(160))), t), ' ') AS ws FROM kept)"""
_KEPT = f"""regexp_extract_all(a, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\\b'), regexp_extract_all(a, '\\b\\d+(?:\\.\\d+)?\\s+(?:{"|".join(X.UNIT_FORMS)})\\b')"""
#: SQL: tok -> part (seg_id, part from 1, shown): F8 as a recursion over what is left, from the table of all stretches of words.
_PARTS = f"""one AS (SELECT seg_id, dur, ws, len(ws) AS n, length(array_to_string(ws, ' ')) AS whole FROM tok),
pair AS (SELECT seg_id, ws, i, z, array_to_string(ws[i + 1:z], ' ') AS tx FROM (SELECT *, unnest(range(i + 1, least(n, i + 43) + 1)) AS z FROM (SELECT *, unnest(range(0, n)) AS i FROM one WHERE whole > 42 OR dur > 6000)) WHERE length(array_to_string(ws[i + 1:z], ' ')) <= 85),
cut AS (SELECT seg_id, i, z, ws[k] AS a, ws[k + 1] AS b, array_to_string(ws[i + 1:k], ' ') AS l, array_to_string(ws[k + 1:z], ' ') AS rr FROM (SELECT *, unnest(range(i + 1, z)) AS k FROM pair WHERE length(tx) > 42)),
two AS (SELECT seg_id, i, z, arg_min(l || chr(10) || rr, (abs(length(l) - length(rr)) + {_SHORT} + greatest(0, length(l) - 38) + greatest(0, length(rr) - 38) + {_PENALTY}, l, rr)) AS shown FROM cut WHERE length(l) <= 42 AND length(rr) <= 42 GROUP BY seg_id, i, z),
fit AS (SELECT pair.seg_id, pair.i, pair.z, length(tx) AS ln, replace(CASE WHEN length(tx) <= 42 THEN tx ELSE shown END, chr(160), ' ') AS shown, ws[pair.z] AS a, ws[pair.z + 1] AS b FROM pair LEFT JOIN two ON pair.seg_id = two.seg_id AND pair.i = two.i AND pair.z = two.z WHERE length(tx) <= 42 OR shown IS NOT NULL),
scored AS (SELECT seg_id, i, z, ln, shown, CASE WHEN b IS NULL OR regexp_matches(a, '[.?!]$') THEN 0 WHEN regexp_matches(a, '[,;:]$') THEN 8 ELSE 16 END + CASE WHEN b IS NULL THEN 0 ELSE {_PENALTY} END AS extra FROM fit),
wholes AS (SELECT one.seg_id, dur, ws, n, whole, coalesce(CASE WHEN whole <= 42 THEN replace(array_to_string(ws, ' '), chr(160), ' ') END, fit.shown) AS at_once FROM one LEFT JOIN fit ON one.seg_id = fit.seg_id AND fit.i = 0 AND fit.z = one.n),
todo AS (SELECT *, greatest(1, ceil(dur / 6000.0), ceil(whole / 80.0)) AS wanted FROM wholes WHERE at_once IS NULL OR dur > 6000),
greedy AS (SELECT seg_id, 0 AS here, 0 AS part, CAST('' AS VARCHAR) AS shown FROM todo
  UNION ALL SELECT seg_id, coalesce(best.z, here + 1), part + 1, coalesce(best.shown, lone) FROM (
    SELECT g.seg_id, g.here, g.part, any_value(replace(ws[g.here + 1], chr(160), ' ')) AS lone, arg_min(struct_pack(z := s.z, shown := s.shown), (abs(s.ln - greatest(20, ceil(length(array_to_string(ws[g.here + 1:], ' ')) / greatest(1, wanted - g.part)))) + s.extra, s.z - g.here, s.shown)) FILTER (s.z IS NOT NULL) AS best
    FROM greedy g JOIN todo ON g.seg_id = todo.seg_id AND g.here < todo.n LEFT JOIN scored s ON s.seg_id = g.seg_id AND s.i = g.here GROUP BY g.seg_id, g.here, g.part)),
part AS (SELECT seg_id, part, shown FROM greedy WHERE part > 0 UNION ALL SELECT seg_id, 1, at_once FROM wholes WHERE at_once IS NOT NULL AND dur <= 6000)"""

#: SQL: o (seg_id, b, ce, long, split, bare): when the speech of each segment is shown.
_TIMES = ISLANDS + f""",
i AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY n DESC, start_ms, end_ms) AS best FROM x),
z AS (SELECT seg_id, arg_min(s, i) AS ws, arg_max(e, i) AS we FROM w GROUP BY seg_id),
y AS (SELECT i.seg_id, count(*) AS islands, min(start_ms) FILTER (best = 1) AS ds, min(end_ms) FILTER (best = 1) AS de FROM i GROUP BY i.seg_id),
nx AS (SELECT i.seg_id, min(i.start_ms) AS later FROM i JOIN y ON i.seg_id = y.seg_id AND i.start_ms > y.ds GROUP BY i.seg_id),
v AS (SELECT seg.seg_id, coalesce(ws, start_ms) AS s, coalesce(we, end_ms) AS e, {_V.format('en')} AS vis, lead(coalesce(ws, start_ms)) OVER (PARTITION BY series, episode ORDER BY pos, id) AS nxt, coalesce(islands, 0) AS islands, ds, de, later
  FROM seg LEFT JOIN z ON seg.seg_id = z.seg_id LEFT JOIN y ON seg.seg_id = y.seg_id LEFT JOIN nx ON seg.seg_id = nx.seg_id WHERE trim(en) <> '' AND end_ms > start_ms),
t AS (SELECT *, e - s > 6001 AS long, e - s > 6001 AND islands > 1 AS split, e - s > 6001 AND islands = 0 AS bare FROM v),
u AS (SELECT *, CASE WHEN split THEN ds ELSE s END AS s2, CASE WHEN split THEN least(greatest(de, ds + least(6000, greatest(700, CAST(ceil(vis * 1000 / 15) AS BIGINT)))), least(later, nxt) - 80) WHEN bare THEN least(s + least(6000, greatest(1000, CAST(ceil(vis * 1000 / 15) AS BIGINT))), nxt - 80) ELSE e END AS te FROM t),
p AS (SELECT *, greatest(0, s2 - 50) AS b, CASE WHEN nxt IS NOT NULL THEN greatest(0, nxt - 50) END AS nb FROM u),
c AS (SELECT *, least(te + 100, nb - CASE WHEN nb - te >= 130 THEN 80 ELSE 0 END) AS ce FROM p),
o AS (SELECT seg_id, b, CASE WHEN split OR bare THEN least(ce, b + 6000) ELSE ce END AS ce, long, split, bare FROM c)"""
#: SQL: done: the cues of every segment, with what its layout did.
_REFINED = _TIMES.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
gl AS (SELECT series, list(DISTINCT en) AS names FROM glossary WHERE en IS NOT NULL GROUP BY series),
r AS (SELECT seg.seg_id, ce - b AS dur, {_SQUEEZE} AS t, coalesce(names, []) AS names FROM seg JOIN o ON seg.seg_id = o.seg_id LEFT JOIN gl ON seg.series = gl.series WHERE ce > b),
m AS (SELECT *, regexp_replace(t, '{_ACCENTED}', '0', 'g') AS a FROM r), e AS (SELECT seg_id, dur, t, list_distinct(list_concat(list_filter(names, lambda n: n <> '' AND contains(t, n)), {_KEPT})) AS es FROM m), {_TOKENS}, {_PARTS},
wt AS (SELECT seg_id, part, shown, greatest(1, {_V.format('shown')}) AS wt, count(*) OVER (PARTITION BY seg_id) AS k FROM part),
ah AS (SELECT *, sum(wt) OVER (PARTITION BY seg_id) AS total, coalesce(sum(wt) OVER (PARTITION BY seg_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM wt),
gp AS (SELECT ah.*, b, ce - b AS dur, long, split, bare, CASE WHEN {_V.format('seg.en')} * 1000 <= 17 * greatest(1, ce - b - 80 * (k - 1)) THEN 80 ELSE 0 END AS gap, series, episode, pos, seg.id AS source_id, b <> start_ms OR ce <> end_ms AS moved,
  ws IS NULL AS wordless, coalesce(ws - start_ms > 300, false) AS led, coalesce(end_ms - we > 300, false) AS trailed, text_zh, avg_logprob, no_speech_prob FROM ah JOIN o ON ah.seg_id = o.seg_id JOIN seg ON seg.seg_id = ah.seg_id LEFT JOIN z ON z.seg_id = ah.seg_id),
pl AS (SELECT *, dur - gap * (k - 1) AS room FROM gp),
cu AS (SELECT *, CAST(b + room * ahead // total + (part - 1) * gap AS BIGINT) AS s, CAST(b + room * (ahead + wt) // total + (part - 1) * gap AS BIGINT) AS e FROM pl WHERE room > 0),
ov AS (SELECT seg_id, coalesce(end_ms > lead(start_ms) OVER (PARTITION BY series, episode ORDER BY pos, id), false) AS source_overlap FROM seg WHERE trim(en) <> '' AND end_ms > start_ms),
ch AS (SELECT seg_id, coalesce(list_contains(list_transform(range(1, greatest(length(text_zh) - 2, 1)), lambda i: substr(text_zh, i, 4) = repeat(substr(text_zh, i, 1), 4)), true), false) OR coalesce(avg_logprob < -1, false) OR coalesce(no_speech_prob > 0.6, false) AS suspect FROM seg),
done AS (SELECT series, episode, row_number() OVER q AS id, source_id, part, k, s AS start_ms, coalesce(least(e, lead(s) OVER q), e) AS end_ms, shown AS text, coalesce(lead(s) OVER q < e, false) AS fixed, long AS anomaly, split, bare, moved, wordless, led, trailed, source_overlap, suspect
  FROM cu JOIN ov ON cu.seg_id = ov.seg_id JOIN ch ON cu.seg_id = ch.seg_id WINDOW q AS (PARTITION BY series, episode ORDER BY pos, source_id, part))"""

SQL = {
    "visible_and_rate": f"WITH {LATEST} SELECT cue_id, {_V.format('text')} AS visible, CAST(floor({_V.format('text')} * 1000000 / (end_ms - start_ms)) AS BIGINT) AS rate FROM cue WHERE end_ms > start_ms AND text IS NOT NULL",
    "time_texts": f"WITH {LATEST} SELECT cue_id, lpad(CAST(ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS t, ms FROM (SELECT cue_id, greatest(0, start_ms) AS ms FROM cue WHERE start_ms IS NOT NULL)",
    "numbers_found": f"SELECT DISTINCT doc_id, unnest({_NUM.format('text')}) AS number FROM documents WHERE text IS NOT NULL",
    "numbers_lost": f"""WITH {LATEST}, b AS (SELECT cue_id, cue.text, coalesce(seg.en, '') AS en FROM cue JOIN seg ON cue.series = seg.series AND cue.episode = seg.episode AND cue.source_id = seg.id)
SELECT DISTINCT cue_id, number FROM (SELECT cue_id, en, unnest({_NUM.format('text')}) AS number FROM b) WHERE NOT list_contains({_NUM.format('en')}, number)""",
    "han_share": f"WITH {LATEST} SELECT seg_id, len(regexp_extract_all(text_zh, '[\\x{{3400}}-\\x{{9FFF}}]')) AS han, length(text_zh) AS n FROM seg WHERE text_zh IS NOT NULL",
    "phrase_counts": f"WITH {LATEST} SELECT series, " + ", ".join(f"CAST(sum((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{p.lower()}', ''))) // {len(p)}) AS BIGINT) AS {p.lower().replace(' ', '_')}" for p in X.TRANSLATIONESE) + " FROM cue GROUP BY series",
    "entity_extract": f"WITH {LATEST} SELECT DISTINCT seg_id, unnest(regexp_extract_all(text_zh, '[\\x{{4E00}}-\\x{{9FFF}}]{{1,8}}(?:{'|'.join(X.ENTITY_SUFFIXES)})')) AS entity FROM seg WHERE text_zh IS NOT NULL",
    "wrap_two_lines": f"WITH {LATEST}, r AS (SELECT seg_id, {_SQUEEZE} AS t FROM seg WHERE en IS NOT NULL AND length({_SQUEEZE}) >= 1)," + _cuts(f"abs(length(l) - length(rr)) + {_SHORT} + greatest(0, length(l) - 38) + greatest(0, length(rr) - 38) + {_PENALTY}", "greatest(length(l), length(rr)) <= 42") + " SELECT r.seg_id, CASE WHEN length(t) <= 42 THEN t ELSE two END AS lines FROM r LEFT JOIN best ON r.seg_id = best.seg_id",
    "legacy_format": f"""WITH RECURSIVE {LATEST},
names AS (SELECT series, en, row_number() OVER (PARTITION BY series ORDER BY length(en) DESC, en) AS k FROM (SELECT DISTINCT series, en FROM glossary WHERE section = 'characters' AND en IS NOT NULL AND en <> '')),
q AS (SELECT seg_id, series, 0 AS k, {_SQUEEZE} AS plain, {_SQUEEZE} AS t FROM seg WHERE en IS NOT NULL
  UNION ALL SELECT seg_id, q.series, names.k, plain, replace(t, names.en, replace(names.en, ' ', chr(160))) FROM q JOIN names ON q.series = names.series AND names.k = q.k + 1),
r AS (SELECT seg_id, plain, t FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY k DESC) AS last FROM q) WHERE last = 1),""" + _cuts(f"abs(length(l) - length(rr)) + 10 * greatest(0, greatest(length(l), length(rr)) - 42) + {_SHORT}", "true") + " SELECT r.seg_id, CASE WHEN length(plain) <= 42 THEN plain ELSE replace(coalesce(two, t), chr(160), ' ') END AS lines FROM r LEFT JOIN best ON r.seg_id = best.seg_id",
    "layout_tokens": f"""WITH {LATEST}, g AS (SELECT series, list(DISTINCT en) AS names FROM glossary WHERE en IS NOT NULL GROUP BY series),
r AS (SELECT seg_id, {_SQUEEZE} AS t, coalesce(names, []) AS names FROM seg LEFT JOIN g ON seg.series = g.series WHERE en IS NOT NULL),
m AS (SELECT *, regexp_replace(t, '{_ACCENTED}', '0', 'g') AS a FROM r),
e AS (SELECT seg_id, t, list_distinct(list_concat(list_filter(names, lambda n: n <> '' AND contains(t, n)), regexp_extract_all(a, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\\b'), regexp_extract_all(a, '\\b\\d+(?:\\.\\d+)?\\s+(?:{"|".join(X.UNIT_FORMS)})\\b'))) AS es FROM m),
o AS (SELECT seg_id, t, list_transform(list_sort(list_transform(es, lambda x: struct_pack(n := -length(x), x := x))), lambda y: y.x) AS es FROM e)
SELECT seg_id, replace(replace(list_reduce(es, lambda acc, x: replace(acc, x, replace(x, ' ', chr(160))), t), ' ', '|'), chr(160), ' ') AS words FROM o""",
    "split_text": f"""WITH RECURSIVE {LATEST}, r AS (SELECT seg_id, end_ms - start_ms AS dur, {_SQUEEZE} AS t FROM seg WHERE end_ms > start_ms AND trim(en) <> ''),
m AS (SELECT *, regexp_replace(t, '{_ACCENTED}', '0', 'g') AS a FROM r), e AS (SELECT seg_id, dur, t, list_distinct(list_concat({_KEPT})) AS es FROM m), {_TOKENS}, {_PARTS}
SELECT seg_id, part - 1 AS part, shown AS text FROM part""",
    "refine_single": _TIMES + """
SELECT seg_id, b AS cue_start_ms, ce AS cue_end_ms, long AS anomaly, split AS island_split, bare AS fallback_capped FROM o WHERE ce > b""",
    "refine_cues": _REFINED + " SELECT series, episode, id, source_id, start_ms, end_ms, text, fixed FROM done",
    "layout_failures": _REFINED + """ SELECT series, episode, id, 'no_time' AS problem FROM seg JOIN o ON seg.seg_id = o.seg_id WHERE NOT ce > b
UNION ALL SELECT series, episode, source_id, 'no_room' FROM pl WHERE room <= 0 AND part = 1 UNION ALL SELECT series, episode, id, 'invalid_times' FROM seg WHERE trim(coalesce(en, '')) <> '' AND NOT coalesce(end_ms > start_ms, false)""",
    "qc_report": _REFINED + f""",
q AS (SELECT *, CAST(floor({_V.format('text')} * 1000000 / greatest(1, end_ms - start_ms)) AS BIGINT) AS rate, len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS widest, end_ms - start_ms AS duration, lead(start_ms) OVER (PARTITION BY series, episode ORDER BY id) AS nxt,
  lower(text) AS low, string_split(trim(regexp_replace(text, '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')), ' ') AS ws FROM done),
q2 AS (SELECT *, ws[len(ws)] AS a FROM q)
SELECT series, episode, count(*) AS total_cues, count(*) FILTER (end_ms > nxt) AS overlaps, count(*) FILTER (nxt - end_ms < 79) AS gap_violations, count(*) FILTER (lines > 2) AS over_two_lines, count(*) FILTER (widest > 42) AS long_lines, count(*) FILTER (duration < 700) AS short_cues,
  count(*) FILTER (rate > 22000) AS high_cps_cues, count(*) FILTER (rate > 20000) AS high_cps_over_20, count(*) FILTER (rate > 25000) AS severe_cps_over_25, median(rate) AS median_cps, CAST(quantile_disc(rate, 0.95) AS BIGINT) AS p95_cps, max(rate) AS max_cps, max(lines) AS max_lines, max(duration) AS max_duration,
  count(*) FILTER (fixed) AS overlaps_fixed, count(*) FILTER (part = 1 AND k > 1) AS long_cues_split, count(*) FILTER (part = 1 AND (moved OR k > 1)) AS timing_adjustments, count(*) FILTER (part = 1 AND wordless) AS missing_word_timestamps, count(*) FILTER (part = 1 AND anomaly) AS timing_anomalies_detected,
  count(*) FILTER (part = 1 AND (split OR bare)) AS timing_anomalies_fixed, count(*) FILTER (part = 1 AND split) AS speech_island_splits, count(*) FILTER (part = 1 AND bare) AS segment_fallback_capped, count(*) FILTER (part = 1 AND led) AS leading_silence_trimmed, count(*) FILTER (part = 1 AND trailed) AS trailing_silence_trimmed,
  count(*) FILTER (part = 1 AND NOT wordless) AS word_bounds_used, count(*) FILTER (part = 1 AND source_overlap) AS overlaps_before, CASE WHEN count(*) FILTER (part = 1 AND wordless) = count(*) FILTER (part = 1) THEN 'segment' WHEN count(*) FILTER (part = 1 AND wordless) > 0 THEN 'mixed' ELSE 'word' END AS timing_alignment,
  count(*) FILTER (rate > 20000) AS needs_condensation, count(*) FILTER (part = 1 AND anomaly) AS long_duration_cues_before, count(*) FILTER (duration > 6001) AS long_duration_cues_after, count(*) FILTER (duration > 6001) + count(*) FILTER (widest > 42) AS issues,
  count(*) FILTER (nxt IS NOT NULL AND ({_BARE.format("a")} IN ({_AVOID}) OR {_BARE.format("a")} LIKE '%''s')) AS awkward_split_warnings, count(*) FILTER (part = 1 AND suspect) AS asr_suspect, CAST(0 AS BIGINT) AS splits_rejected_due_to_cps,
  """ + ", ".join(f"CAST(sum((length(low) - length(replace(low, '{p.lower()}', ''))) // {len(p)}) AS BIGINT) AS phrase_{p.lower().replace(' ', '_')}" for p in X.TRANSLATIONESE) + ", CAST(NULL AS BIGINT) AS not_shown FROM q2 GROUP BY series, episode",
    "timing_drift": f"""WITH {LATEST} SELECT cue.series, cue.episode, bool_and(cue.start_ms >= seg.start_ms - 51 AND cue.end_ms <= seg.end_ms + 101) AS ok FROM cue JOIN seg ON cue.series = seg.series AND cue.episode = seg.episode AND cue.source_id = seg.id
WHERE cue.end_ms > cue.start_ms AND seg.end_ms > seg.start_ms GROUP BY ALL""",
    "cue_metrics": f"""WITH {LATEST}, v AS (SELECT series, episode, start_ms, end_ms, text, {_RATE} AS rate, len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS widest, end_ms - start_ms AS duration,
  lead(start_ms) OVER (PARTITION BY series, episode ORDER BY id, cue_id) AS nxt FROM cue WHERE end_ms > start_ms AND text IS NOT NULL)
SELECT series, episode, count(*) AS total_cues, count(*) FILTER (end_ms > nxt) AS overlaps, count(*) FILTER (nxt - end_ms < 79) AS gap_violations, count(*) FILTER (lines > 2) AS over_two_lines, count(*) FILTER (widest > 42) AS long_lines, count(*) FILTER (duration < 700) AS short_cues,
  count(*) FILTER (rate > 22000) AS high_cps_cues, count(*) FILTER (rate > 20000) AS high_cps_over_20, count(*) FILTER (rate > 25000) AS severe_cps_over_25, median(rate) AS median_cps, CAST(quantile_disc(rate, 0.95) AS BIGINT) AS p95_cps, max(rate) AS max_cps, max(lines) AS max_lines, max(duration) AS max_duration
FROM v GROUP BY ALL""",
    "cue_validate": f"""WITH {LATEST}, v AS (SELECT cue_id, start_ms, end_ms, text, end_ms - start_ms AS d, lag(end_ms) OVER o AS pe, lag(text) OVER o AS pt, string_split(coalesce(text, ''), chr(10)) AS lines FROM cue WINDOW o AS (PARTITION BY series, episode ORDER BY id, cue_id))
SELECT cue_id, 'error' AS level, 'time' AS problem FROM v WHERE coalesce(start_ms < 0, false) OR coalesce(d <= 0, true) UNION ALL SELECT cue_id, 'error', 'lines' FROM v WHERE len(lines) > 2 OR list_max(list_transform(lines, lambda x: length(x))) > 42
UNION ALL SELECT cue_id, 'error', 'long' FROM v WHERE d > 6001 UNION ALL SELECT cue_id, 'error', 'overlap' FROM v WHERE pe > start_ms UNION ALL SELECT cue_id, 'warning', 'short' FROM v WHERE d < 500 UNION ALL SELECT cue_id, 'warning', 'repeated' FROM v WHERE text = pt""",
    "awkward_boundaries": f"""WITH {LATEST}, v AS (SELECT cue_id, lead(cue_id) OVER (PARTITION BY series, episode ORDER BY id, cue_id) AS nxt, string_split(trim(regexp_replace(text, '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')), ' ') AS ws FROM cue WHERE text IS NOT NULL), l AS (SELECT cue_id, nxt, ws[len(ws)] AS a FROM v)
SELECT cue_id FROM l WHERE nxt IS NOT NULL AND ({_BARE.format("a")} IN ({_AVOID}) OR {_BARE.format("a")} LIKE '%''s')""",
    "rate_warnings": f"WITH {LATEST}, v AS (SELECT series, episode, {_V.format('text')} * 1000.0 / (end_ms - start_ms) AS r FROM cue WHERE end_ms > start_ms AND text IS NOT NULL) SELECT series, episode, count(*) FILTER (r > 20) AS over_20, count(*) FILTER (r > 25) AS over_25 FROM v GROUP BY ALL HAVING count(*) FILTER (r > 20) > 0",
    "response_contract": f"""WITH {LATEST}, b AS (SELECT series, episode, (pos - 1) // 10 AS batch, arg_min(CASE WHEN en IS NULL THEN 'keys' ELSE 'text' END, pos) FILTER (en IS NULL OR trim(en, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) = '') AS bad FROM seg GROUP BY ALL),
r AS (SELECT CASE WHEN batch % 3 = 2 THEN 'root' ELSE coalesce(bad, '') END AS reason FROM b) SELECT CASE WHEN reason = '' THEN 'ok' ELSE 'parse' END AS status, reason, count(*) AS n FROM r GROUP BY ALL""",
    "example_pick": f"WITH {LATEST} SELECT series, episode, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY series, episode ORDER BY CASE WHEN length(coalesce(en, '')) > 84 OR coalesce(end_ms - start_ms > 6000, false) THEN 0 ELSE 1 END, pos, seg_id) AS k FROM seg) WHERE k = 1",
    "srt_roundtrip": f"""WITH {LATEST}, v AS (SELECT series, episode, cue.id AS cid, start_ms, end_ms, trim(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g')) AS text FROM cue WHERE end_ms > start_ms)
SELECT series, episode, row_number() OVER (PARTITION BY series, episode ORDER BY cid) AS id, greatest(0, start_ms) AS start_ms, greatest(0, end_ms) AS end_ms, text FROM v WHERE trim(coalesce(text, '')) <> ''""",
    "natural_order": f"""WITH {LATEST}, e AS (SELECT DISTINCT episode FROM seg), x AS (SELECT episode, regexp_extract_all(episode, '\\d+') AS d, regexp_extract_all(lower(episode), '\\d+|\\D+') AS p FROM e)
SELECT episode, CASE WHEN regexp_matches(episode, '^\\d') THEN '|' ELSE '' END || array_to_string(list_transform(p, lambda y: CASE WHEN regexp_full_match(y, '\\d+') THEN lpad(y, 20, '0') ELSE y END), '|') AS key FROM x WHERE len(d) > 0 AND CAST(d[len(d)] AS BIGINT) >= 3""",
    "risk_reasons": f"""WITH {LATEST}, b AS (SELECT cue_id, seg.text_zh AS z, seg.en AS o, cue.text AS n FROM cue JOIN seg ON cue.series = seg.series AND cue.episode = seg.episode AND cue.source_id = seg.id WHERE seg.text_zh IS NOT NULL AND seg.en IS NOT NULL AND cue.text IS NOT NULL)
SELECT cue_id, concat_ws(',', CASE WHEN len(list_filter({_NUM.format('o')}, lambda x: NOT list_contains({_NUM.format('n')}, x))) > 0 THEN 'numbers' END, CASE WHEN {_V.format('o')} > 0 AND {_V.format('n')} < {_V.format('o')} * CAST(0.55 AS DOUBLE) THEN 'aggressive_compression' END,
  CASE WHEN {_HAS('lower(o)', condense.LORE_EN)} OR {_HAS('z', condense.LORE_ZH)} THEN 'lore' END, CASE WHEN {_HAS('lower(o)', condense.CAUSAL)} <> {_HAS('lower(n)', condense.CAUSAL)} THEN 'causal_temporal' END,
  CASE WHEN length(o) - length(replace(o, ',', '')) > length(n) - length(replace(n, ',', '')) THEN 'clause_collapse' END) AS reasons FROM b""",
    "severe_sources": f"""WITH {LATEST}, v AS (SELECT *, {_V.format('text')} * 1000.0 / (end_ms - start_ms) AS r FROM cue WHERE end_ms > start_ms AND source_id IS NOT NULL)
SELECT series, episode, source_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms FROM v GROUP BY ALL HAVING bool_or(coalesce(r > 25, false))""",
}
QUERIES = {
    f.__name__: f
    for f in (
        visible_and_rate, time_texts, numbers_found, numbers_lost, han_share, phrase_counts, entity_extract, entity_pairs, wrap_two_lines, legacy_format, layout_tokens, split_text, refine_cues, refine_single, qc_report, timing_drift, cue_metrics,
        cue_validate, awkward_boundaries, rate_warnings, layout_failures, example_pick, srt_roundtrip, natural_order, response_contract, risk_reasons, severe_sources, condense_outcomes,
    )
}
