import datetime
import json

import pytest

from subtide import clients, pipeline
from subtide.config import EngineConfig

VIDEO = "series string, episode string, path string, size bigint, modified timestamp"
TEXTS = {"1": ["玄冥来了，", "快走！", "我在山门等你。"], "2": ["别动，有人来了。", "坏"]}


def tools(log, broken=False):
    """Stubs made here travel to the tasks by value, so they import what they need; every call leaves a file."""
    texts = TEXTS

    def note(kind, what):
        import uuid

        (log / f"{kind}-{uuid.uuid4().hex}").write_text(what)

    class Recogniser:
        def recognise(self, audio, task):
            note("asr", task)
            said = texts[audio.decode()]
            return [{"start_ms": 2000 * i, "end_ms": 2000 * i + 1900, "text_zh": t if task == "transcribe" else f"English {i}" if i else " ", "words": None} for i, t in enumerate(said)]

        def window(self, audio, start, end):
            note("window", "x")
            return {"start_ms": 400, "end_ms": end - start - 400, "text_zh": "再见"}

    class Voice:
        def speech(self, audio):
            return [(0, 1900), (9000, 10_500)]

    class Requester:
        def request(self, ids, targets, previous, following, glossary):
            import json

            from subtide.clients import ReplyError

            note("llm", json.dumps([targets, previous, following, glossary], ensure_ascii=False))
            if broken and "坏" in targets:
                raise ReplyError("length", "key sesame too long")
            english = {"玄冥来了，快走！": "Xuanming is coming, go!"}
            return [{"id": i, "en": english.get(t, f" Sentence number {i} of this. ")} for i, t in zip(ids, targets, strict=True)]

    return pipeline.Tools(lambda p: p.encode(), Recogniser, Voice, Requester, lambda _z, old, *_: old[:-8], lambda *_: "ACCEPT")


def calls(log, kind):
    return [json.loads(p.read_text()) if kind == "llm" else p.read_text() for p in log.glob(f"{kind}-*")]


@pytest.fixture
def world(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    at = datetime.datetime(2024, 1, 1)
    videos = spark.createDataFrame([("s", e, e, 10, at) for e in TEXTS], VIDEO)
    glossary = spark.createDataFrame([("s", "characters", "玄冥", "Xuanming")], "series string, section string, source string, en string")
    return videos, glossary, str(tmp_path / "store"), tmp_path / "out", log


def test_high_mode_end_to_end(spark, world):
    videos, glossary, store, out, log = world
    run = lambda n, **k: {r.episode: r.state for r in pipeline.high(spark, videos, glossary, store, str(out), tools(log, k.pop("broken", False)), pipeline.Options(run=n, secret="sesame", **k)).collect()}
    assert run(1, broken=True) == {"1": "done", "2": "failed"}
    failed = spark.read.parquet(f"{store}/failures.parquet").collect()
    assert [(r.episode, r.status, r.reason) for r in failed] == [("2", "length", "key [REDACTED] too long")]
    assert len(calls(log, "asr")) == 2 and calls(log, "window")
    (first,) = [c for c in calls(log, "llm") if "玄冥来了，快走！" in c[0]]
    assert first[3] == [{"term": "玄冥", "en": "Xuanming", "authority": "manual"}] and "再见" in first[0]
    srt = "".join(p.read_text() for p in (out / "srt").rglob("*.txt"))
    assert "Xuanming is coming, go!" in srt and "再见" in "".join(p.read_text() for p in (out / "zh").rglob("*.txt"))
    # The second run resumes: nothing is recognised again, only the failed batch is asked for, the first episode is skipped.
    before = len(calls(log, "llm"))
    assert run(2) == {"1": "skipped", "2": "done"}
    assert len(calls(log, "asr")) == 2 and len(calls(log, "llm")) == before + 1
    assert len(list((out / "srt").rglob("*.txt"))) == 2  # what was written before stays
    # A third one that lays everything out anew takes all from the store.
    assert run(3, overwrite=True) == {"1": "done", "2": "done"} and len(calls(log, "llm")) == before + 1
    reports = [json.loads(x) for p in (out / "qc").rglob("*.json") for x in p.read_text().splitlines()]
    assert len(reports) == 2 and {r["asr_segments_recovered"] for r in reports} == {1} and all(r["overlaps"] == 0 for r in reports)
    # A term that binds from now on: translations that break it are asked for again.
    held = spark.createDataFrame([("s", "山门", "Mountain Gate", "manual", True, "manual")], pipeline.TABLES["terms"])
    pipeline.Store(spark, store).replace("terms", held)
    assert run(4, overwrite=True)["1"] == "failed" and len(calls(log, "llm")) == before + 2


def test_fast_mode_and_summary(spark, world):
    videos, _, store, out, log = world
    done = pipeline.fast(spark, videos, store, str(out), tools(log))
    assert {(r.state, r.srt) for r in done.collect()} == {("done", "1.en.srt"), ("done", "2.en.srt")} and pipeline.exit_code(done) == 0
    texts = sorted(p.read_text() for p in (out / "srt").rglob("*.txt"))
    assert len(texts) == 2 and all(t.startswith("1\n00:00:02,000 --> ") and "English 1" in t for t in texts)
    again = pipeline.fast(spark, videos, store, str(out), tools(log))
    assert [(r.state, r.n) for r in pipeline.state_counts(again).collect()] == [("skipped", 2)]
    assert pipeline.exit_code(spark.createDataFrame([("failed",)], "state string")) == 1
    with pytest.raises(ValueError, match="positive"):
        pipeline.Options(config=EngineConfig(batch_size=0))


def test_http_requests_keep_the_contract():
    sent, answers = [], ["no json", {"length": 1}, "ok"]

    def send(url, headers, body):
        sent.append((url, headers, body))
        kind = answers.pop(0)
        if kind == "no json":
            return '{"choices":[{"message":{"content":"sorry"},"finish_reason":"stop"}]}'
        if kind != "ok":
            return '{"choices":[{"message":{"content":"x"},"finish_reason":"length"}]}'
        return json.dumps({"choices": [{"message": {"content": json.dumps({"translations": [{"id": 5, "en": "Go."}]})}, "finish_reason": "stop"}]}) + "\ndata: [DONE]"

    client = clients.HttpRequester("http://x/v1/", "sesame", "m", sleep=lambda _s: None, send=send)
    assert client.request([5], ["走"], ["前"], [], [{"term": "走", "en": "Go"}]) == [{"id": 5, "en": "Go."}]
    assert [b["max_tokens"] for _, _, b in sent] == [4096, 4096, 8192] and len(sent[1][2]["messages"]) == 3
    assert sent[0][0] == "http://x/v1/chat/completions" and json.loads(sent[0][2]["messages"][1]["content"])["previous_context"] == ["前"]

    def refuse(*_):
        raise clients.ReplyError("unsupported")

    client = clients.HttpRequester("http://x", "sesame", "m", sleep=lambda _s: None, send=refuse)
    with pytest.raises(clients.ReplyError):
        client.request([5], ["走"], [], [], [])
    assert client._retrying.capabilities == []
