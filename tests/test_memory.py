import itertools
import random

import pytest
from pyspark.sql import functions as F

from subtide import clients
from subtide.operators import condense, layout
from subtide.operators import memory as M
from subtide.streaming import learning

TERMS = "series string, source string, en string, status string, locked boolean, source_type string"
OCC = "series string, episode string, cue string, source string, en string, context string, suspect boolean, seq bigint"
GLOSSARY = "series string, section string, source string, en string"


def terms(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], TERMS)


def test_longest_match_and_precedence(spark):
    t = terms(spark, ("甲", "A", "confirmed", False, "learned"), ("甲乙", "AB", "confirmed", True, "manual"), ("甲乙丙", "ABC", "manual", False, "manual"), ("丁", "D", "candidate", False, "learned"), ("\\E|(", "Odd", "manual", True, "manual"))
    g = spark.createDataFrame([("s", "terms", "甲乙丙", "Gloss"), ("s", "characters", "甲乙丙", "Other")], GLOSSARY)
    entries = M.dictionary(g, t)
    texts = spark.createDataFrame([("s", "甲乙丙丁甲\\E|("), ("s", None), ("t", "甲")], "series string, text_zh string")
    got = {r.term: (r.en, r.authority) for r in M.resolve(texts, entries).collect()}
    assert got == {"甲乙丙": ("Gloss", "manual"), "甲": ("A", "confirmed"), "\\E|(": ("Odd", "locked")}
    trie = {r.term: (r.en, r.authority) for r in M.resolve_by_trie(texts, entries).collect()}
    assert trie == got
    whole = {(r.text, r.term) for r in M.contained(texts.select("series", F.col("text_zh").alias("text")).filter("text is not null"), entries).collect()}
    assert whole == {("甲乙丙丁甲\\E|(", x) for x in ("甲", "甲乙", "甲乙丙", "\\E|(")}


def test_a_dictionary_in_many_blocks_gives_the_same(spark, monkeypatch):
    r = random.Random(9)
    words = sorted({"".join(r.choice("甲乙丙丁") for _ in range(r.randrange(1, 5))) for _ in range(60)})
    entries = spark.createDataFrame([(s, w, w, "manual") for s in ("s", "t") for w in words], "series string, source string, en string, authority string")
    texts = spark.createDataFrame([("s", "".join(r.choice("甲乙丙丁戊") for _ in range(40))) for _ in range(30)] + [("u", "甲"), ("s", "")], "series string, text_zh string")
    key = lambda df: sorted((x.series, x.text, x.term) for x in df.collect())
    one = key(M.resolve(texts, entries))
    monkeypatch.setattr(M, "TRIE_CHARS", 40)
    assert one and one == key(M.resolve_by_trie(texts, entries))
    monkeypatch.setattr(M, "PATTERN_TERMS", 0)
    assert one == key(M.resolve(texts, entries)) and M.resolve(texts, entries.limit(0)).count() == 0


def test_signature_depends_on_relevant_terms_only(spark):
    texts = spark.createDataFrame([("s", "玄冥来了"), ("s", "走吧")], "series string, text_zh string")
    sign = lambda t, style: {r.text: r.signature for r in M.memory_keys(texts, M.dictionary(spark.createDataFrame([], GLOSSARY), t), style, "1").collect()}
    a = sign(terms(spark, ("玄冥", "Xuanming", "manual", True, "manual")), "x")
    b = sign(terms(spark, ("玄冥", "Xuan Ming", "manual", True, "manual")), "x")
    assert a["走吧"] == b["走吧"] and a["玄冥来了"] != b["玄冥来了"]
    assert sign(terms(spark), "y")["走吧"] != a["走吧"]


def simulate(rows, after=3):
    seen, held, trusted, first, mixed = set(), None, 0, None, False
    out = []
    for cue, en, suspect, seq in sorted(rows, key=lambda r: r[3]):
        if cue in seen:
            continue
        seen.add(cue)
        if held is not None:
            out.append((seq, False, en != held))
            continue
        first = en if first is None else first
        mixed = mixed or en != first
        trusted += not suspect
        promote = not mixed and trusted >= after
        out.append((seq, promote, False))
        held = first if promote else None
    return out


def test_learning_equals_a_simulation(spark):
    cases = [list(zip(ens, sus, strict=True)) for ens in itertools.product("AB", repeat=4) for sus in ((0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 1, 1))]
    rows = [("s", "e", str(i), f"x{c}", en, None, bool(s), c * 100 + i) for c, case in enumerate(cases) for i, (en, s) in enumerate([*case, case[0]])]
    got = {}
    for r in M.observe(spark.createDataFrame(rows, OCC)).collect():
        got.setdefault(r.source, []).append((r.seq, r.promotes, r.conflict))
    for c in range(len(cases)):
        mine = [(r[2], r[4], r[6], r[7]) for r in rows if r[3] == f"x{c}"]
        assert sorted(got[f"x{c}"]) == simulate(mine), cases[c]


def test_locked_term_survives_conflicts_and_repeats_count_once(spark):
    occ = spark.createDataFrame([("s", "e", str(i % 4), "玄冥", "Wrong", None, False, i) for i in range(8)], OCC)
    seen = M.observe(occ, terms(spark, ("玄冥", "Xuanming", "manual", True, "manual")))
    assert M.conflicts(seen).count() == 4 and M.promotions(seen).count() == 0
    assert [tuple(r) for r in M.candidate_counts(occ).collect()] == [("s", "玄冥", "Wrong", 4)]


def test_memory_hits_and_client(spark):
    targets = spark.createDataFrame([(i, "s", f"句{i}", "k") for i in range(1, 7)], "id bigint, series string, source string, signature string")
    memory = spark.createDataFrame([("s", f"句{i}", "k", f"E{i}", i) for i in (1, 3, 6)] + [("s", "句1", "k", "New", 9), ("s", "句2", "other", "No", 10), ("s", "句4", "k", None, 11)], "series string, source string, signature string, en string, seq bigint")
    got = {r.id: r.memory_en for r in M.partition_hits(targets, memory).collect()}
    assert got == {1: "New", 2: None, 3: "E3", 4: None, 5: None, 6: "E6"}
    done = clients.translate_with(spark.createDataFrame([("k", "abc")], "series string, source string"), clients.UpperTranslator)
    assert done.first().en == "ABC" and done.first().status == "ok"


def test_retries_adapt():
    seen = []

    def call(rows, **how):
        seen.append(how)
        if len(seen) == 1:
            raise clients.ReplyError("length")
        if len(seen) == 2:
            raise clients.ReplyError("unsupported")
        return [{"id": r["id"], "en": "x"} for r in rows] if len(seen) == 4 else [{"id": 99, "en": "x"}]

    pauses = []
    out = clients.Retrying(call, sleep=pauses.append).translate([{"id": 1, "source": "x"}])
    assert out == [{"id": 1, "en": "x"}] and pauses == [1, 2, 4]
    assert seen[1]["budget"] == 8192 and seen[2]["capabilities"] == ("temperature",) and seen[3]["correction"]
    with pytest.raises(RuntimeError):
        clients.with_ladder(lambda *_: None, lambda _: (_ for _ in ()).throw(RuntimeError("disk")))
    assert clients.with_ladder(lambda m, k: (m, k), lambda c: c if c[0] == "medium" else (_ for _ in ()).throw(RuntimeError("CUDA out of memory"))) == ("medium", "float16")


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq bigint, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("c", 2, "u")], old.schema)
    assert sorted(tuple(r) for r in M.upsert_latest(old, new, ["k"]).collect()) == [("a", 2, "z"), ("b", 1, "y"), ("c", 2, "u")]
    assert sorted(tuple(r) for r in M.insert_first(old, new, ["k"]).collect()) == [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "w")]
    t = terms(spark, ("甲", "A", "confirmed", False, "learned"))
    assert M.lock_term(t, "s", "甲").first().locked and M.delete_term(t, "s", "甲").count() == 0
    assert M.set_term(t, "s", "甲", "B").first().en == "B" and M.search(t, "a").count() == 1


WORDS = "array<struct<start_ms:bigint,end_ms:bigint,word:string>>"
SEG = f"series string, episode string, pos int, id int, start_ms bigint, end_ms bigint, text_zh string, words {WORDS}, en string"


def condensable(spark, *texts, duration=1200):
    """Segments a second and a bit long with a silence after each, and their cues."""
    seg = spark.createDataFrame([("s", "1", i + 1, i, 3000 * i, 3000 * i + duration, z, None, en) for i, (z, en) in enumerate(texts)], SEG)
    return seg, layout.refine(seg)


def test_condensation_outcomes(spark):
    replies = {"I will go there right now my friend at once": "I will go there now my friend", "the long cycle of reincarnation goes on and on": "reincarnation goes on and on and on", "Xuanming has come to the mountain gate today": "He came to the mountain gate today", "I will stay here right now my friend I think": "I will stay here right now my friend I think so"}
    seg, cue = condensable(spark, *zip(["好", "轮回", "玄冥", "好"], replies, strict=True))
    entries = M.dictionary(spark.createDataFrame([("s", "terms", "玄冥", "Xuanming")], GLOSSARY), terms(spark))
    done = lambda verdict, cache=None: condense.condense(seg, cue, lambda _z, o, *_: replies[o], lambda *_: verdict, entries, cache)
    run = lambda *a: {r.source_id: r.outcome for r in done(*a).collect()}
    assert run("REJECT") == {0: "accepted", 1: "semantic_risk", 2: "terminology", 3: "no_improvement"}
    accepted = done("ACCEPT")
    assert {r.source_id: r.outcome for r in accepted.collect()}[1] == "accepted"
    (counts,) = condense.outcome_counts(accepted).collect()
    assert (counts.targeted, counts.accepted, counts.terminology, counts.no_improvement, counts.generation, counts.cache_miss, counts.verification, counts.verification_avoided) == (4, 2, 1, 1, 4, 4, 1, 1)
    cache = condense.cache_entries(accepted, 1)
    assert condense.cache_entries(done("REJECT"), 1).count() == 1  # what is rejected is not cached
    assert run("REJECT", cache) == {0: "cache_hit", 1: "cache_hit", 2: "terminology", 3: "no_improvement"}
    (again,) = condense.outcome_counts(done("REJECT", cache)).collect()
    assert (again.cache_hit, again.generation) == (2, 2)
    assert {r.en for r in condense.apply(seg, accepted).collect()} >= {"I will go there now my friend", "Xuanming has come to the mountain gate today"}


def test_condensation_sees_its_context(spark):
    seg, cue = condensable(spark, ("一", "One."), ("二", "Two."), ("三", "I will go there right now my friend at once"), ("四", "Four."), ("五", "Five."), ("六", "Six."))
    tell = lambda _z, _o, before, after: " ".join(x["zh"] + x["en"][0] for x in before) + "|" + " ".join(x["zh"] for x in after)
    (row,) = condense.condense(seg, cue, tell, lambda *_: "ACCEPT", M.dictionary(spark.createDataFrame([], GLOSSARY), terms(spark))).collect()
    assert (row.source_id, row.condensed) == (2, "一O 二T|四 五")


@pytest.mark.parametrize(("wide_at", "reply", "expected"), [
    (None, "I will go there right now my friend at once and never come", {"first": "accepted", "last": "accepted"}),
    (2, "I will go there right now my friend at once and never come", {"first": "no_improvement", "last": "no_improvement"}),
    (0, "x" * 45, {"first": "no_improvement", "last": "no_improvement"}),
])
def test_a_trial_layout_may_leave_no_long_line(spark, wide_at, reply, expected):
    long, wide = "I will go there right now my friend at once and never come back to you again", "w" * 50
    texts = [("一", long), ("二", "Two."), ("三", wide if wide_at == 2 else "Three."), ("四", long + "!")]
    seg, cue = condensable(spark, *texts)
    done = condense.condense(seg, cue, lambda _z, o, *_: o if o == wide else reply, lambda *_: "ACCEPT", M.dictionary(spark.createDataFrame([], GLOSSARY), terms(spark)))
    got = {r.source_id: r.outcome for r in done.collect()}
    assert (got[0], got[3]) == (expected["first"], expected["last"])


def test_the_last_long_line_gone_frees_what_follows(spark):
    long, wide = "I will go there right now my friend at once and never come back to you again", "w" * 50
    seg, cue = condensable(spark, ("一", long), ("二", wide), ("三", long + "!"))
    done = condense.condense(seg, cue, lambda _z, o, *_: "w" * 30 if o == wide else "I will go there right now my friend at once and never come", lambda *_: "ACCEPT", M.dictionary(spark.createDataFrame([], GLOSSARY), terms(spark)))
    assert {r.source_id: r.outcome for r in done.collect()} == {0: "no_improvement", 1: "accepted", 2: "accepted"}


def test_stream_learns_as_the_batch_does(spark, tmp_path):
    r = random.Random(5)
    rows = [("s", "e", str(i), f"x{r.randrange(6)}", r.choice("AAAB"), None, r.random() < 0.2, i) for i in range(120)]
    df = spark.createDataFrame(rows, OCC)
    for k in range(3):
        df.filter(f"seq % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = learning.observe_stream(stream).writeStream.format("memory").queryName("learned").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(x.source, x.en) for x in spark.sql("select * from learned where event = 'promoted'").collect()}
    assert got == {(x.source, x.en) for x in M.observe(df).filter("promotes").collect()}
