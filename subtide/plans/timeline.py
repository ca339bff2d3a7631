"""Queries of the timeline and sequence operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import text as X
from subtide.functions import words as W
from subtide.functions.columns import big
from subtide.operators import audit, folds, layout, timeline
from subtide.plans.periods import LATEST
from subtide.sources import tables

KEYS = ["series", "episode"]
#: SQL: words of current segments, one row each, without null words; seg and cue as in LATEST.
FLAT = f"""WITH {LATEST},
w AS (SELECT seg_id, i, words[i].start_ms AS s, words[i].end_ms AS e, words[i].word AS word
      FROM (SELECT seg_id, words, unnest(range(1, len(words) + 1)) AS i FROM seg WHERE words IS NOT NULL) WHERE words[i].start_ms IS NOT NULL AND words[i].end_ms IS NOT NULL)"""


def _segments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tables.segments(spark, folder, *KEYS, *columns)


def _cues(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tables.cues(spark, folder, *KEYS, *columns)


def word_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of the words of each segment with more than 800 ms between them."""
    rows = tables.segments(spark, folder, "words").select("seg_id", F.posexplode(W.islands(W.present(F.col("words")), 800)).alias("i", "x"))
    return rows.select("seg_id", big(F.col("i") + 1).alias("island"), "x.start_ms", "x.end_ms", big(F.col("x.n")).alias("n"))


def cue_islands(spark: SparkSession, folder: str) -> DataFrame:
    """W1 over the cues of an episode: a new stretch after more than 2 s of silence."""
    out = timeline.islands(_cues(spark, folder, "start_ms", "end_ms"), KEYS, 2000, ["cue_id"])
    return out.select(*KEYS, big(F.col("island")).alias("island"), "start_ms", "end_ms", big(F.col("n")).alias("n"))


def dominant_islands(spark: SparkSession, folder: str) -> DataFrame:
    """The island with most words."""
    rows = tables.segments(spark, folder, "words").select("seg_id", W.dominant(W.islands(W.present(F.col("words")), 800)).alias("d")).filter("d is not null")
    return rows.select("seg_id", "d.start_ms", "d.end_ms", big(F.col("d.n")).alias("n"))


def interval_union(spark: SparkSession, folder: str) -> DataFrame:
    """Cues joined where no more than 200 ms lie between them."""
    out = timeline.union_intervals(_cues(spark, folder, "start_ms", "end_ms"), KEYS, 200, tie="cue_id")
    return out.select(*KEYS, "start_ms", "end_ms", big(F.col("n")).alias("n"))


def interval_subtract(spark: SparkSession, folder: str) -> DataFrame:
    """What the cues of an episode leave of each segment, in pieces of at least 350 ms."""
    seg = tables.valid_times(_segments(spark, folder, "start_ms", "end_ms"))
    return timeline.subtract_intervals(seg, tables.valid_times(_cues(spark, folder, "start_ms", "end_ms")), KEYS, "seg_id", 350, tie="cue_id")


def uncovered_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Segments stand for speech, cues for what is covered."""
    return timeline.uncovered_windows(_segments(spark, folder, "start_ms", "end_ms"), _cues(spark, folder, "start_ms", "end_ms"), KEYS, tie="cue_id")


def window_cap(spark: SparkSession, folder: str) -> DataFrame:
    """O3: the first three windows of each episode. A top-k report."""
    out = timeline.top_k(uncovered_windows(spark, folder), KEYS, [F.col("start_ms"), F.col("end_ms")], 3)
    return out.select(*KEYS, "start_ms", "end_ms", big(F.col("rank")).alias("rank"))


def range_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Recovered segments and the others within two seconds."""
    seg = tables.valid_times(_segments(spark, folder, "start_ms", "end_ms", "recovered"))
    near = timeline.range_neighbours(seg.filter("recovered").select(*KEYS, "seg_id", "start_ms", "end_ms"), seg.filter("not coalesce(recovered, false)").select(*KEYS, "seg_id", "start_ms", "end_ms"), KEYS)
    return near.select("seg_id", "row_seg_id")


def suspect_flags(spark: SparkSession, folder: str) -> DataFrame:
    """P7."""
    rows = audit.flag_suspects(tables.valid_times(tables.segments(spark, folder, "id", "start_ms", "end_ms", "words")))
    return rows.select("seg_id", F.concat_ws(",", "suspect_reasons").alias("reasons"), F.col("largest_internal_gap_ms").alias("largest_gap_ms"), big(F.col("speech_islands")).alias("islands"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    """W4."""
    rows = timeline.sentence_split(tables.segments(spark, folder, "start_ms", "end_ms", "text_zh", "words"))
    return rows.select("seg_id", "sentence", "start_ms", "end_ms", "text_zh")


def overlap_repair(spark: SparkSession, folder: str) -> DataFrame:
    """W8, in the order of start."""
    out = timeline.repair_overlaps(tables.valid_times(_cues(spark, folder, "start_ms", "end_ms")), KEYS, ["start_ms", "cue_id"])
    return out.select("cue_id", "start_ms", "end_ms", "fixed")


def adjacent_violations(spark: SparkSession, folder: str) -> DataFrame:
    """W11."""
    out = timeline.adjacent_violations(tables.valid_times(_cues(spark, folder, "start_ms", "end_ms")), KEYS, ["start_ms", "cue_id"])
    return out.select(*KEYS, big(F.col("overlaps")).alias("overlaps"), big(F.col("gap_violations")).alias("gap_violations"))


def adjacent_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """W16."""
    return timeline.adjacent_duplicates(_cues(spark, folder, "id", "text"), KEYS, ["id", "cue_id"], "text", "cue_id").select("cue_id", "text")


def context_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of ten segments with five texts before and three after."""
    out = timeline.context_frames(_segments(spark, folder, "pos", "text_zh"), KEYS, "pos", "text_zh")
    join = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), "|")
    return out.select(*KEYS, big(F.col("batch")).alias("batch"), join("previous").alias("previous"), join("following").alias("following"))


def proportional_timing(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of a segment share its time by their characters."""
    rows = timeline.sentence_split(tables.valid_times(tables.segments(spark, folder, "start_ms", "end_ms", "text_zh", "words")).withColumns({"seg_s": F.col("start_ms"), "room": F.col("end_ms") - F.col("start_ms")}))
    rows = rows.withColumns({"weight": F.greatest(F.lit(1), X.visible(F.col("text_zh"))), "gap": F.lit(0)})
    out = timeline.proportional_times(rows, ["seg_id"], "sentence", "weight", "seg_s", "room", "gap")
    return out.select("seg_id", "sentence", big(F.col("part_start_ms")).alias("part_start_ms"), big(F.col("part_end_ms")).alias("part_end_ms"))


def cleanup_fold(spark: SparkSession, folder: str) -> DataFrame:
    """W5."""
    return folds.cleanup(_segments(spark, folder, "pos", "start_ms", "end_ms", "text_zh", "words")).select(*KEYS, "id", "start_ms", "end_ms", "text_zh")


def next_source(spark: SparkSession, folder: str) -> DataFrame:
    """A segment's speech span and where the next segment begins to speak."""
    words = W.present(F.col("words"))
    rows = _segments(spark, folder, "pos", "start_ms", "end_ms", "words").withColumn("first", F.coalesce(F.get(words, F.lit(0))["start_ms"], F.col("start_ms")))
    near = timeline.with_next(rows, KEYS, ["pos", "seg_id"], ["first"])
    span = W.span(F.col("start_ms"), F.col("end_ms"), words)
    return near.select("seg_id", span["start_ms"].alias("speech_start_ms"), span["end_ms"].alias("speech_end_ms"), F.col("after.first").alias("next_ms"))


def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    """X1, A10 with a stub that hears every window: cues stand for speech."""
    seg = _segments(spark, folder, "id", "start_ms", "end_ms", "text_zh", "words", "recovered")
    speech = tables.valid_times(_cues(spark, folder, "start_ms", "end_ms")).select(*KEYS, "start_ms", "end_ms")

    def hear(windows: DataFrame) -> DataFrame:
        word = F.struct("start_ms", "end_ms", F.lit("再见").alias("word"))
        return windows.withColumns({"text_zh": F.when(F.col("start_ms") % 3 == 0, "哈哈哈哈").otherwise("再见"), "words": F.array(word)})

    _, report = audit.audit(seg, speech, hear)
    return report


def recovery_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """P8 over every current segment as if it had been recovered, beside the others within two seconds of it."""
    seg = _segments(spark, folder, "start_ms", "end_ms", "text_zh")
    timed = tables.valid_times(seg)
    near = timeline.range_neighbours(timed.select(*KEYS, "seg_id", "start_ms", "end_ms"), timed, KEYS).filter("seg_id <> row_seg_id")
    texts = near.groupBy("seg_id").agg(F.collect_set("row_text_zh").alias("near"))  # of a few seconds
    return seg.join(texts, "seg_id", "left").select("seg_id", audit.recovery_verdict(F.col("text_zh"), F.col("near")).alias("verdict"))


def recognition_suspects(spark: SparkSession, folder: str) -> DataFrame:
    """P9, P10."""
    rows = tables.segments(spark, folder, "text_zh", "avg_logprob", "no_speech_prob")
    return rows.filter(layout.recognition_suspect(F.col("text_zh"), F.col("avg_logprob"), F.col("no_speech_prob"))).select("seg_id")


_LEAD = "lead({0}) OVER (PARTITION BY series, episode ORDER BY {1})"
ISLANDS = FLAT + """,
g AS (SELECT *, s - lag(e) OVER (PARTITION BY seg_id ORDER BY i) AS gap FROM w),
l AS (SELECT *, sum(CASE WHEN gap > 800 THEN 1 ELSE 0 END) OVER (PARTITION BY seg_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 1 AS island FROM g),
x AS (SELECT seg_id, CAST(island AS BIGINT) AS island, arg_min(s, i) AS start_ms, arg_max(e, i) AS end_ms, count(*) AS n FROM l GROUP BY ALL)
"""
_UNION = """,
{0}m AS (SELECT *, max(e) OVER (PARTITION BY {1} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {2}),
{0}l AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + {3} THEN 1 ELSE 0 END) OVER (PARTITION BY {1} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {0}m),
{0}u AS (SELECT {1}, island, min(s) AS s, max(e) AS e, count(*) AS n FROM {0}l GROUP BY ALL)"""
_SUBTRACT = f"""WITH {LATEST},
c AS (SELECT series, episode, start_ms AS s, end_ms AS e FROM cue WHERE end_ms > start_ms)""" + _UNION.format("c", "series, episode", "c", 0) + """,
a AS ({0}),
h AS (SELECT a.*, greatest(cu.s, a.s) AS hs, least(cu.e, a.e) AS he FROM a JOIN cu ON a.series = cu.series AND a.episode = cu.episode AND cu.s < a.e AND cu.e > a.s),
borders AS (
  SELECT series, episode, ident, s AS p, coalesce((SELECT min(hs) FROM h WHERE h.ident = a.ident AND h.series = a.series AND h.episode = a.episode), e) AS q FROM a
  UNION ALL SELECT series, episode, ident, he, coalesce(lead(hs) OVER (PARTITION BY series, episode, ident ORDER BY hs), e) FROM h)
"""
_WINDOWS = _SUBTRACT.format("SELECT DISTINCT series, episode, start_ms * 100000000 + end_ms AS ident, start_ms AS s, end_ms AS e FROM seg WHERE end_ms - start_ms >= 350") + """,
p AS (SELECT series, episode, greatest(0, p - 400) AS s, q + 400 AS e FROM borders WHERE q - p >= 350)""" + _UNION.format("p", "series, episode", "p", 200)
_VALID_CUE = "SELECT * FROM cue WHERE end_ms > start_ms"
_SENTENCES = FLAT + r""",
k AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(trim(word), '[。！？!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY seg_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS sentence FROM w),
x AS (
  SELECT seg_id, CAST(sentence AS BIGINT) AS sentence, arg_min(s, i) AS start_ms, arg_max(e, i) AS end_ms, trim(coalesce(string_agg(word, '' ORDER BY i), '')) AS text_zh FROM k GROUP BY ALL
  UNION ALL SELECT seg_id, 1, start_ms, end_ms, trim(text_zh) FROM seg WHERE seg_id NOT IN (SELECT seg_id FROM w)),
sent AS (SELECT * FROM x WHERE text_zh <> '')
"""

SQL = {
    "word_islands": ISLANDS + "SELECT * FROM x",
    "dominant_islands": ISLANDS + "SELECT seg_id, start_ms, end_ms, n FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY n DESC, start_ms, end_ms) AS rn FROM x) WHERE rn = 1",
    "cue_islands": f"""WITH {LATEST},
g AS (SELECT *, row_number() OVER o AS place, start_ms - lag(end_ms) OVER o AS gap FROM cue WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL WINDOW o AS (PARTITION BY series, episode ORDER BY start_ms, end_ms, cue_id)),
l AS (SELECT *, max(CASE WHEN gap IS NULL OR gap > 2000 THEN place END) OVER (PARTITION BY series, episode ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT series, episode, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM l GROUP BY ALL""",
    "interval_union": f"WITH {LATEST}, c AS (SELECT series, episode, start_ms AS s, end_ms AS e FROM cue WHERE end_ms > start_ms)" + _UNION.format("c", "series, episode", "c", 200) + " SELECT series, episode, s AS start_ms, e AS end_ms, n FROM cu",
    "interval_subtract": _SUBTRACT.format("SELECT series, episode, seg_id AS ident, start_ms AS s, end_ms AS e FROM seg WHERE end_ms - start_ms >= 350") + "SELECT series, episode, ident AS seg_id, p AS start_ms, q AS end_ms FROM borders WHERE q - p >= 350",
    "uncovered_windows": _WINDOWS + " SELECT series, episode, s AS start_ms, e AS end_ms FROM pu",
    "window_cap": _WINDOWS + " SELECT * FROM (SELECT series, episode, s AS start_ms, e AS end_ms, row_number() OVER (PARTITION BY series, episode ORDER BY s, e) AS rank FROM pu) WHERE rank <= 3",
    "range_neighbours": f"""WITH {LATEST}, v AS (SELECT * FROM seg WHERE end_ms > start_ms)
SELECT a.seg_id, b.seg_id AS row_seg_id FROM v a JOIN v b ON a.series = b.series AND a.episode = b.episode AND b.end_ms > a.start_ms - 2000 AND b.start_ms < a.end_ms + 2000
WHERE a.recovered AND NOT coalesce(b.recovered, false)""",
    "suspect_flags": FLAT + """,
g AS (SELECT *, s - lag(e) OVER (PARTITION BY seg_id ORDER BY i) AS gap FROM w),
x AS (SELECT seg_id, greatest(coalesce(max(gap), 0), 0) AS largest, count(*) FILTER (gap > 2000) + 1 AS islands, arg_min(s, i) AS s, arg_max(e, i) AS e, coalesce(max(gap), 0) AS raw FROM g GROUP BY seg_id)
SELECT seg.seg_id, concat_ws(',', CASE WHEN islands > 1 THEN 'multiple_speech_islands' END, CASE WHEN raw >= 2000 THEN 'large_internal_word_gap' END, CASE WHEN coalesce(x.e, end_ms) - coalesce(x.s, start_ms) > 6000 THEN 'long_duration' END) AS reasons,
  coalesce(largest, 0) AS largest_gap_ms, coalesce(islands, 0) AS islands FROM seg LEFT JOIN x ON seg.seg_id = x.seg_id WHERE end_ms > start_ms""",
    "sentence_split": _SENTENCES + "SELECT * FROM sent",
    "overlap_repair": f"WITH {LATEST}, v AS ({_VALID_CUE}), n AS (SELECT *, {_LEAD.format('start_ms', 'start_ms, cue_id')} AS nxt FROM v) SELECT cue_id, start_ms, least(end_ms, nxt) AS end_ms, coalesce(nxt < end_ms, false) AS fixed FROM n",
    "adjacent_violations": f"WITH {LATEST}, v AS ({_VALID_CUE}), n AS (SELECT *, {_LEAD.format('start_ms', 'start_ms, cue_id')} AS nxt FROM v) SELECT series, episode, count(*) FILTER (end_ms > nxt) AS overlaps, count(*) FILTER (nxt - end_ms < 79) AS gap_violations FROM n GROUP BY ALL",
    "adjacent_duplicates": f"WITH {LATEST}, n AS (SELECT *, lag(text) OVER (PARTITION BY series, episode ORDER BY id, cue_id) AS before FROM cue) SELECT cue_id, text FROM n WHERE text = before",
    "context_frames": f"""WITH {LATEST}, b AS (SELECT *, (pos - 1) // 10 AS batch FROM seg), d AS (SELECT DISTINCT series, episode, batch FROM b),
p AS (SELECT d.*, string_agg(coalesce(text_zh, ''), '|' ORDER BY pos) AS x FROM d JOIN b ON b.series = d.series AND b.episode = d.episode AND pos - 1 BETWEEN d.batch * 10 - 5 AND d.batch * 10 - 1 GROUP BY ALL),
f AS (SELECT d.*, string_agg(coalesce(text_zh, ''), '|' ORDER BY pos) AS x FROM d JOIN b ON b.series = d.series AND b.episode = d.episode AND pos - 1 BETWEEN d.batch * 10 + 10 AND d.batch * 10 + 12 GROUP BY ALL)
SELECT d.series, d.episode, CAST(d.batch AS BIGINT) AS batch, coalesce(p.x, '') AS previous, coalesce(f.x, '') AS following
FROM d LEFT JOIN p ON d.series = p.series AND d.episode = p.episode AND d.batch = p.batch LEFT JOIN f ON d.series = f.series AND d.episode = f.episode AND d.batch = f.batch""",
    "proportional_timing": _SENTENCES + r""",
t AS (SELECT sent.seg_id, sentence, seg.start_ms AS s, seg.end_ms - seg.start_ms AS room, greatest(1, length(regexp_replace(sent.text_zh, '[\s\x{A0}\x{3000}]', '', 'g'))) AS weight FROM sent JOIN seg ON sent.seg_id = seg.seg_id WHERE seg.end_ms > seg.start_ms),
a AS (SELECT *, sum(weight) OVER (PARTITION BY seg_id) AS total, coalesce(sum(weight) OVER (PARTITION BY seg_id ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM t)
SELECT seg_id, sentence, CAST(s + room * ahead // total AS BIGINT) AS part_start_ms, CAST(s + room * (ahead + weight) // total AS BIGINT) AS part_end_ms FROM a""",
    "next_source": FLAT + """,
f AS (SELECT seg_id, arg_min(s, i) AS fs, arg_max(e, i) AS fe FROM w GROUP BY seg_id),
x AS (SELECT seg.seg_id, series, episode, pos, coalesce(fs, start_ms) AS speech_start_ms, coalesce(fe, end_ms) AS speech_end_ms FROM seg LEFT JOIN f ON seg.seg_id = f.seg_id)
SELECT seg_id, speech_start_ms, speech_end_ms, lead(speech_start_ms) OVER (PARTITION BY series, episode ORDER BY pos, seg_id) AS next_ms FROM x""",
    "recovery_verdicts": rf"""WITH {LATEST}, v AS (SELECT * FROM seg WHERE end_ms > start_ms), t AS (SELECT *, coalesce(text_zh, '') AS x, regexp_replace(coalesce(text_zh, ''), '[\s\x{{A0}}\x{{3000}}\x{{2002}}\x{{2009}}\x{{202F}}]', '', 'g') AS bare, len(regexp_extract_all(coalesce(text_zh, ''), '[\x{{3400}}-\x{{9FFF}}]')) AS han FROM seg),
dup AS (SELECT DISTINCT a.seg_id FROM v a JOIN v b ON a.series = b.series AND a.episode = b.episode AND a.seg_id <> b.seg_id AND b.end_ms > a.start_ms - 2000 AND b.start_ms < a.end_ms + 2000 JOIN t ta ON ta.seg_id = a.seg_id JOIN t tb ON tb.seg_id = b.seg_id WHERE tb.bare <> '' AND (contains(tb.bare, ta.bare) OR contains(ta.bare, tb.bare))),
rep AS (SELECT seg_id, list_bool_or(list_transform(range(1, length(x) + 1), lambda i: (i + 2 <= length(x) AND substr(x, i, 1) = substr(x, i + 1, 1) AND substr(x, i, 1) = substr(x, i + 2, 1)) OR (i + 5 <= length(x) AND substr(x, i, 2) = substr(x, i + 2, 2) AND substr(x, i, 2) = substr(x, i + 4, 2)) OR (i + 8 <= length(x) AND substr(x, i, 3) = substr(x, i + 3, 3) AND substr(x, i, 3) = substr(x, i + 6, 3)))) AS r FROM t)
SELECT t.seg_id, CASE WHEN trim(x) = '' OR han = 0 THEN 'empty_or_no_chinese' WHEN han * 2 < length(trim(x)) THEN 'mostly_non_chinese' WHEN rep.r THEN 'repetition' WHEN dup.seg_id IS NOT NULL THEN 'duplicate_neighbor' ELSE 'ok' END AS verdict FROM t LEFT JOIN rep ON rep.seg_id = t.seg_id LEFT JOIN dup ON dup.seg_id = t.seg_id""",
    "audit_report": "WITH RECURSIVE " + _SUBTRACT.replace("WITH ", "", 1).replace("FROM cue WHERE", "FROM orig WHERE").replace("\nc AS (SELECT", "\norig AS (SELECT * FROM seg WHERE NOT coalesce(recovered, false)),\nc AS (SELECT", 1).format("SELECT DISTINCT series, episode, start_ms * 100000000 + end_ms AS ident, start_ms AS s, end_ms AS e FROM cue WHERE end_ms - start_ms >= 350") + """,
p AS (SELECT series, episode, greatest(0, p - 400) AS s, q + 400 AS e FROM borders WHERE q - p >= 350)""" + _UNION.format("p", "series, episode", "p", 200) + rf""",
win AS (SELECT series, episode, s, e, CASE WHEN s % 3 = 0 THEN '哈哈哈哈' ELSE '再见' END AS x FROM (SELECT *, row_number() OVER (PARTITION BY series, episode ORDER BY s, e) AS rank FROM pu) WHERE rank <= 20),
near AS (SELECT win.series, win.episode, win.s, win.e, bool_or(b <> '' AND (contains(b, x) OR contains(x, b))) AS dup FROM win JOIN (SELECT *, regexp_replace(coalesce(text_zh, ''), '[\s\x{{A0}}\x{{3000}}\x{{2002}}\x{{2009}}\x{{202F}}]', '', 'g') AS b FROM orig WHERE end_ms >= start_ms) r ON win.series = r.series AND win.episode = r.episode AND r.end_ms > win.s - 2000 AND r.start_ms < win.e + 2000 GROUP BY ALL),
jud AS (SELECT win.*, x = '再见' AND NOT coalesce(dup, false) AS ok FROM win LEFT JOIN near ON win.series = near.series AND win.episode = near.episode AND win.s = near.s AND win.e = near.e),
ev AS (SELECT series, episode, start_ms AS s, end_ms AS e, false AS rec, CAST(id AS BIGINT) AS id FROM orig WHERE end_ms > start_ms UNION ALL SELECT series, episode, s, e, true, 1000000000 + s FROM jud WHERE ok),
od AS (SELECT *, row_number() OVER v AS k, lead(s) OVER v AS high FROM ev WINDOW v AS (PARTITION BY series, episode ORDER BY s, id)),
fo AS (SELECT series, episode, k, rec, e AS low, true AS kept FROM (SELECT *, 1 AS one FROM od WHERE k = 1 AND NOT rec) UNION ALL SELECT series, episode, k, rec, least(coalesce(high, e), e), least(coalesce(high, e), e) > s FROM od WHERE k = 1 AND rec
  UNION ALL SELECT od.series, od.episode, od.k, od.rec, CASE WHEN NOT od.rec THEN od.e WHEN least(coalesce(high, od.e), od.e) > greatest(low, od.s) THEN least(coalesce(high, od.e), od.e) ELSE low END, NOT od.rec OR least(coalesce(high, od.e), od.e) > greatest(low, od.s) FROM fo JOIN od ON fo.series = od.series AND fo.episode = od.episode AND od.k = fo.k + 1),
wo AS (SELECT seg_id, i, words[i].start_ms AS s, words[i].end_ms AS e FROM (SELECT seg_id, words, unnest(range(1, len(words) + 1)) AS i FROM orig WHERE words IS NOT NULL) WHERE words[i].start_ms IS NOT NULL AND words[i].end_ms IS NOT NULL),
ga AS (SELECT *, s - lag(e) OVER (PARTITION BY seg_id ORDER BY i) AS gap FROM wo),
fl AS (SELECT seg_id, coalesce(max(gap), 0) AS raw, count(*) FILTER (gap > 2000) AS cuts, arg_min(s, i) AS ws, arg_max(e, i) AS we FROM ga GROUP BY seg_id),
ba AS (SELECT series, episode, count(*) AS original, count(*) FILTER (coalesce(cuts > 0, false) OR coalesce(raw >= 2000, false) OR coalesce(coalesce(we, end_ms) - coalesce(ws, start_ms) > 6000, false)) AS suspects, count(*) FILTER (raw >= 2000) AS large_gaps FROM orig LEFT JOIN fl ON orig.seg_id = fl.seg_id GROUP BY ALL),
wc AS (SELECT series, episode, count(*) AS windows, count(*) FILTER (ok) AS recovered, count(*) FILTER (NOT ok) AS rejected FROM jud GROUP BY ALL), mc AS (SELECT series, episode, count(*) FILTER (rec AND kept) AS merged FROM fo GROUP BY ALL)
SELECT 2 AS version, true AS enabled, ba.series, ba.episode, original, coalesce(windows, 0) AS windows, coalesce(recovered, 0) AS recovered, coalesce(merged, 0) AS merged, coalesce(rejected, 0) AS rejected, suspects, large_gaps
FROM ba LEFT JOIN wc ON ba.series = wc.series AND ba.episode = wc.episode LEFT JOIN mc ON ba.series = mc.series AND ba.episode = mc.episode""",
    "cleanup_fold": FLAT.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
z AS (SELECT seg_id, arg_min(s, i) AS ws, arg_max(e, i) AS we FROM w GROUP BY seg_id),
r AS (SELECT series, episode, greatest(0, start_ms) AS st, end_ms AS en, trim(text_zh) AS tx, ws, we, row_number() OVER (PARTITION BY series, episode ORDER BY pos, greatest(0, start_ms), end_ms) AS k FROM seg LEFT JOIN z ON seg.seg_id = z.seg_id WHERE trim(text_zh) <> '' AND end_ms > greatest(0, start_ms)),
f AS (SELECT series, episode, k, CAST(1 AS BIGINT) AS id, st, en, tx, ws, we FROM r WHERE k = 1
  UNION ALL SELECT series, episode, k, CASE WHEN how = 2 THEN id + 1 ELSE id END, CASE WHEN how = 2 THEN nst ELSE st END, CASE WHEN how = 0 THEN greatest(en, nen) ELSE nen END,
    CASE how WHEN 2 THEN ntx WHEN 1 THEN tx || ntx ELSE tx END, CASE how WHEN 2 THEN nws WHEN 1 THEN coalesce(ws, nws) ELSE ws END, CASE how WHEN 2 THEN nwe WHEN 1 THEN coalesce(nwe, we) ELSE we END
  FROM (SELECT f.series, f.episode, r.k, f.id, f.st, f.en, f.tx, f.ws, f.we, r.st AS nst, r.en AS nen, r.tx AS ntx, r.ws AS nws, r.we AS nwe,
    CASE WHEN r.tx = f.tx AND r.st <= f.en THEN 0 WHEN regexp_matches(f.tx, '[，、,]$') AND r.st - f.en BETWEEN 0 AND 150 AND r.en - f.st <= 6000 AND length(f.tx) + length(r.tx) <= 36 THEN 1 ELSE 2 END AS how
    FROM f JOIN r ON f.series = r.series AND f.episode = r.episode AND r.k = f.k + 1))
SELECT series, episode, id, coalesce(arg_max_null(ws, k), arg_max(st, k)) AS start_ms, coalesce(arg_max_null(we, k), arg_max(en, k)) AS end_ms, arg_max(tx, k) AS text_zh FROM f GROUP BY series, episode, id""",
    "recognition_suspects": f"""WITH {LATEST}, c AS (SELECT *, list_transform(range(1, greatest(length(text_zh) - 2, 1)), lambda i: substr(text_zh, i, 4) = repeat(substr(text_zh, i, 1), 4)) AS r FROM seg)
SELECT seg_id FROM c WHERE coalesce(list_contains(r, true), false) OR coalesce(avg_logprob < -1, false) OR coalesce(no_speech_prob > 0.6, false)""",
}
QUERIES = {
    f.__name__: f
    for f in (
        word_islands, dominant_islands, cue_islands, interval_union, interval_subtract, uncovered_windows, window_cap, range_neighbours, suspect_flags, sentence_split, overlap_repair, adjacent_violations, adjacent_duplicates,
        context_frames, proportional_timing, cleanup_fold, next_source, audit_report, recovery_verdicts, recognition_suspects,
    )
}
