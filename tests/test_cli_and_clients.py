import json

from subtide import cli, clients


def stub():
    """A class made here travels to the tasks by value."""

    class Stub:
        def recognise(self, audio, task):
            return [{"start_ms": 0, "end_ms": 900, "text_zh": task, "words": None}]

        def window(self, audio, start, end):
            return {"start_ms": 0, "end_ms": end - start, "text_zh": "再见"} if audio else None

        def speech(self, audio):
            return [(0, len(audio))]

    return Stub


def test_audio_clients(spark):
    Stub = stub()  # noqa: N806
    files = spark.createDataFrame([("s", "1", "ab"), ("s", "2", "")], "series string, episode string, path string")
    audio = clients.decode_with(files, lambda p: p.encode())
    assert sorted((r.episode, r.end_ms) for r in clients.hear_with(audio, Stub).collect()) == [("1", 2), ("2", 0)]
    assert {r.text_zh for r in clients.recognise_with(audio, Stub, "translate").collect()} == {"translate"}
    windows = spark.createDataFrame([("s", "1", 500, 700), ("s", "2", 0, 5)], "series string, episode string, start_ms bigint, end_ms bigint")
    got = {r.episode: (r.text_zh, r.words) for r in clients.transcribe_with(windows, audio, Stub).collect()}
    assert got["2"] == (None, None) and got["1"][0] == "再见" and (got["1"][1][0].start_ms, got["1"][1][0].end_ms) == (500, 700)
    assert len({clients.prompt(s) for s in clients.STYLES}) == 3


def test_terms_commands(spark, tmp_path):
    store = str(tmp_path)
    spark.createDataFrame([("s", "甲", "A", "confirmed", False, "learned")], "series string, source string, en string, status string, locked boolean, source_type string").write.parquet(f"{store}/terms.parquet")
    spark.createDataFrame([("s", "1", "1", "甲", "B", None, False, 1)], "series string, episode string, cue string, source string, en string, context string, suspect boolean, seq bigint").write.parquet(f"{store}/term_occurrences.parquet")
    run = lambda *a: cli.terms(spark, store, *a).collect()
    assert {r.name: r.n for r in run("stats", "s")} == {"terms": 1, "candidates": 1, "conflicts": 1, "occurrences": 1}
    assert run("lock", "s", "甲")[0].locked and not run("unlock", "s", "甲")[0].locked
    assert len(run("set", "s", "乙", "C")) == 2 and len(run("search", "s", "c")) == 1 and len(run("delete", "s", "乙")) == 1
    assert len(run("list", "s")) == len(run("candidates", "s")) == len(run("conflicts", "s")) == 1
    assert {r.kind for r in run("export", "s")} == {"terms", "candidates", "conflicts"}


def test_validate_and_refine(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    for folder, end in ((good, "00:00:02,000"), (bad, "00:00:09,000")):
        folder.mkdir()
        (folder / "a.srt").write_text(f"1\n00:00:01,000 --> {end}\nHi\n", encoding="utf-8")
    assert cli.validate(spark, str(good)) == 0 and cli.validate(spark, str(bad)) == 1
    states = tmp_path / "states"
    states.mkdir()
    done = {"segments": [{"id": 1, "start_ms": 0, "end_ms": 2000, "text_zh": "x"}], "translations": {"1": "Hello."}}
    (states / "e1.json").write_text(json.dumps(done))
    (states / "e2.json").write_text(json.dumps(done | {"translations": {}}))
    (tmp_path / "g.json").write_text('{"characters":{},"terms":{}}')
    (report,) = cli.refine(spark, str(states), str(tmp_path / "g.json"), str(tmp_path / "out"), "s").collect()
    assert (report.episode, report.total_cues, report.timing_drift_check) == ("e1", 1, True)
    assert any("Hello." in p.read_text() for p in (tmp_path / "out" / "srt").rglob("*.txt"))
