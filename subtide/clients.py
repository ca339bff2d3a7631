"""Pluggable clients for what isn't data processing (speech recognition, voice activity, translation), with stubs.

Clients run inside ``mapInPandas``, one instance per task. Retries and fallbacks belong to the client: Spark may rerun a
task, so callers cut the lineage after a paid call, and the memo table keeps a rerun from asking again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from subtide.config import DEFAULT, EngineConfig
from subtide.operators import contracts


class Translator(Protocol):
    def translate(self, rows: Sequence[dict]) -> list[dict]:
        """rows: id, source, ... -> one {'id', 'en'} for each, in their order."""


class Recogniser(Protocol):
    def recognise(self, audio: bytes, task: str) -> list[dict]:
        """Segments of the whole audio: start_ms, end_ms, text_zh, words. task: 'transcribe' or 'translate'."""

    def window(self, audio: bytes, start_ms: int, end_ms: int) -> dict | None:
        """A segment with times from the start of the audio, or None where nothing is heard."""


class VoiceActivity(Protocol):
    def speech(self, audio: bytes) -> list[tuple[int, int]]:
        """Intervals in milliseconds."""


class Requester(Protocol):
    def request(self, ids: list[int], targets: list[str], previous: list[str], following: list[str], glossary: list[dict]) -> list[dict]:
        """One {'id', 'en'} for each target, in their order; a ReplyError otherwise."""


@dataclass
class UpperTranslator:
    """A deterministic stub."""

    def translate(self, rows: Sequence[dict]) -> list[dict]:
        return [{"id": r["id"], "en": (r["source"] or "").upper()} for r in rows]

    def request(self, ids: list[int], targets: list[str], previous: list[str], following: list[str], glossary: list[dict]) -> list[dict]:
        return [{"id": i, "en": t.upper()} for i, t in zip(ids, targets, strict=True)]


class ReplyError(Exception):
    """kind: empty, parse, length, unsupported or http; it steers what the next attempt changes."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(text or kind)
        self.kind = kind


def _kind(error: Exception) -> str:
    """What kind of reply error it is; any other error goes on. The package is shipped by value, so a client that imports it on
    an executor raises a class that only has the same name."""
    kind = getattr(error, "kind", None)
    if not isinstance(kind, str):
        raise error
    return kind


@dataclass
class Retrying:
    """Attempts with growing pauses; a cut reply gets the larger budget, a malformed one a correction, an unsupported
    request loses a capability for as long as the client lives."""

    call: Callable[..., list[dict]]
    config: EngineConfig = DEFAULT
    sleep: Callable[[float], None] = time.sleep
    capabilities: list[str] = field(default_factory=lambda: ["json_schema", "temperature"])

    def translate(self, rows: Sequence[dict]) -> list[dict]:
        budget, correction = self.config.token_budgets[0], False
        last: Exception | None = None
        for attempt in range(self.config.attempts):
            try:
                out = self.call(rows, budget=budget, correction=correction, capabilities=tuple(self.capabilities))
                if [o["id"] for o in out] != [r["id"] for r in rows]:
                    raise ReplyError("parse", "ids")
                return out
            except Exception as error:
                kind, last = _kind(error), error
                if kind == "length":
                    budget = self.config.token_budgets[1]
                elif kind == "parse":
                    correction = True
                elif kind == "unsupported" and self.capabilities:
                    self.capabilities.pop(0)
                if attempt + 1 < self.config.attempts:
                    self.sleep(2**attempt)
        raise last or ReplyError("http")


@dataclass
class HttpRequester:
    """Asks a chat endpoint; every reply has to keep the strict contracts. The key is in no text that leaves this class."""

    base: str
    key: str
    model: str
    style: str = "subtitle"
    config: EngineConfig = DEFAULT
    timeout: float = 90.0
    sleep: Callable[[float], None] = time.sleep
    send: Callable[[str, dict, dict], str] | None = None
    _retrying: Retrying | None = None

    def _post(self, url: str, headers: dict, body: dict) -> str:
        call = urllib.request.Request(url, json.dumps(body, ensure_ascii=False).encode(), headers)
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as error:
            raise ReplyError("unsupported" if error.code in (400, 422) else "http", f"status {error.code}") from None
        except (urllib.error.URLError, TimeoutError) as error:
            raise ReplyError("http", str(error).replace(self.key, "[REDACTED]") if self.key else str(error)) from None

    def _call(self, rows: Sequence[dict], budget: int, correction: bool, capabilities: Sequence[str]) -> list[dict]:
        asked = rows[0]["request"]
        messages = [{"role": "system", "content": prompt(self.style)}, {"role": "user", "content": json.dumps(asked, ensure_ascii=False)}]
        if correction:
            messages.append({"role": "user", "content": "The last answer did not keep to the format. Answer with that JSON object and nothing else."})
        body = {"model": self.model, "messages": messages, "max_tokens": budget, "stream": False}
        body["response_format"] = {"type": "json_schema", "json_schema": {"name": "translations", "schema": REPLY_SCHEMA}} if "json_schema" in capabilities else {"type": "json_object"}
        if "temperature" in capabilities:
            body["temperature"] = 0
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        status, content, _ = contracts.completion((self.send or self._post)(f"{self.base.rstrip('/')}/chat/completions", headers, body))
        if status == "ok":
            status, _, items = contracts.reply(content, [r["id"] for r in rows])
        if status != "ok":
            raise ReplyError(status)
        return items

    def request(self, ids: list[int], targets: list[str], previous: list[str], following: list[str], glossary: list[dict]) -> list[dict]:
        self._retrying = self._retrying or Retrying(self._call, self.config, self.sleep)
        asked = {"glossary": {g["term"]: g["en"] for g in glossary}, "previous_context": previous, "following_context": following, "targets": [{"id": i, "zh": t} for i, t in zip(ids, targets, strict=True)]}
        return self._retrying.translate([{"id": i, "request": asked} for i in ids])


REPLY_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["translations"],
    "properties": {"translations": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["id", "en"], "properties": {"id": {"type": "integer"}, "en": {"type": "string"}}}}},
}


def request_with(batches: DataFrame, make: Callable[[], Requester]) -> DataFrame:
    """series, episode, batch, status, reason, items of rows (series, episode, batch, ids, targets, previous, following,
    glossary as JSON): all of a batch is accepted or none of it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        whole = lambda x: [] if x is None else list(x)
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                ids = [int(i) for i in r.ids]
                try:
                    items = client.request(ids, whole(r.targets), whole(r.previous), whole(r.following), json.loads(r.glossary or "[]"))
                    good = [g["id"] for g in items] == ids and all((g["en"] or "").strip() for g in items)
                    out.append((r.series, r.episode, r.batch, "ok" if good else "parse", None if good else "items", items if good else None))
                except Exception as error:
                    out.append((r.series, r.episode, r.batch, _kind(error), str(error), None))
            yield pd.DataFrame(out, columns=["series", "episode", "batch", "status", "reason", "items"])

    return batches.mapInPandas(run, "series string, episode string, batch bigint, status string, reason string, items array<struct<id:bigint,en:string>>")


#: What an error of exhausted memory says.
OUT_OF_MEMORY = ("out of memory", "cuda_error_out_of_memory", "cudaerror_memoryallocation", "cublas_status_alloc_failed", "failed to allocate", "not enough memory")
#: Models and number formats, the most demanding first.
LADDER = (("large-v3", "float16"), ("large-v3", "int8_float16"), ("medium", "float16"))


def with_ladder(load: Callable[[str, str], object], run: Callable[[object], object], ladder: Sequence[tuple[str, str]] = LADDER) -> object:
    """Run with the first configuration that memory allows; other errors pass."""
    for i, (model, kind) in enumerate(ladder):
        try:
            return run(load(model, kind))
        except Exception as error:
            if i + 1 == len(ladder) or not any(p in str(error).lower() for p in OUT_OF_MEMORY):
                raise
    raise ValueError("an empty ladder")


def translate_with(df: DataFrame, make: Callable[[], Translator], size: int = DEFAULT.batch_size) -> DataFrame:
    """``df`` (key, source) with en and status: all of a batch is accepted or none of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            ens, states = [], []
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                rows = [{"id": i, "source": s} for i, s in enumerate(part["source"])]
                try:
                    got = client.translate(rows)
                    good = [g["id"] for g in got] == [r["id"] for r in rows] and all((g["en"] or "").strip() for g in got)
                    ens += [g["en"] for g in got] if good else [None] * len(rows)
                    states += ["ok" if good else "parse"] * len(rows)
                except Exception as error:
                    ens += [None] * len(rows)
                    states += [_kind(error)] * len(rows)
            yield batch.assign(en=ens, status=states)

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in types.items()) + ", en string, status string")


def hear_with(audio: DataFrame, make: Callable[[], VoiceActivity]) -> DataFrame:
    """series, episode, start_ms, end_ms of speech in (series, episode, audio binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            rows = [(s, e, a, z) for s, e, wave in zip(batch["series"], batch["episode"], batch["audio"], strict=True) for a, z in client.speech(wave)]
            yield pd.DataFrame(rows, columns=["series", "episode", "start_ms", "end_ms"])

    return audio.select("series", "episode", "audio").mapInPandas(run, "series string, episode string, start_ms bigint, end_ms bigint")


_WORDS = "array<struct<start_ms:bigint,end_ms:bigint,word:string>>"


def decode_with(files: DataFrame, decode: Callable[[str], bytes]) -> DataFrame:
    """series, episode, audio (binary) of (series, episode, path): the decoder runs where the file is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"series": batch["series"], "episode": batch["episode"], "audio": [decode(p) for p in batch["path"]]})

    return files.select("series", "episode", "path").mapInPandas(run, "series string, episode string, audio binary")


def recognise_with(audio: DataFrame, make: Callable[[], Recogniser], task: str = "transcribe") -> DataFrame:
    """series, episode, pos, start_ms, end_ms, text_zh, words; the model is loaded once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            rows = [
                (s, e, i + 1, x["start_ms"], x["end_ms"], x.get("text_zh"), x.get("words"))
                for s, e, wave in zip(batch["series"], batch["episode"], batch["audio"], strict=True)
                for i, x in enumerate(client.recognise(wave, task))
            ]
            yield pd.DataFrame(rows, columns=["series", "episode", "pos", "start_ms", "end_ms", "text_zh", "words"])

    return audio.select("series", "episode", "audio").mapInPandas(run, f"series string, episode string, pos int, start_ms bigint, end_ms bigint, text_zh string, words {_WORDS}")


def transcribe_with(windows: DataFrame, audio: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """``windows`` with text_zh and words of what the recogniser hears in each, null where it hears nothing.

    The client's times count from the window's start; a segment without words becomes one word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            texts, words = [], []
            for wave, start, end in zip(batch["audio"], batch["start_ms"], batch["end_ms"], strict=True):
                heard = client.window(wave, int(start), int(end))
                text = ((heard or {}).get("text_zh") or "").strip()
                if not text:
                    texts.append(None)
                    words.append(None)
                    continue
                said = heard.get("words") or [{"start_ms": heard["start_ms"], "end_ms": heard["end_ms"], "word": text}]
                texts.append(text)
                words.append([{"start_ms": w["start_ms"] + int(start), "end_ms": w["end_ms"] + int(start), "word": w["word"]} for w in said])
            yield batch.drop(columns="audio").assign(text_zh=texts, words=words)

    joined = windows.select("series", "episode", "start_ms", "end_ms").join(audio.select("series", "episode", "audio"), ["series", "episode"])
    return joined.mapInPandas(run, f"series string, episode string, start_ms bigint, end_ms bigint, text_zh string, words {_WORDS}")


STYLES = {
    "subtitle": "Prefer short spoken lines that can be read at a glance.",
    "natural": "Prefer what an English speaker would say over the order of the original.",
    "literal": "Stay close to the wording and the images of the original.",
}


def prompt(style: str, base: str = "Translate the dialogue of a Mandarin drama into English.") -> str:
    """The instruction of a request; it is a part of the memory's keys, so its wording is the version."""
    return f"{base} {STYLES[style]} Use the glossary's renderings exactly. Answer with JSON only: one object whose key is translations, a list of id and en for each target, in order."
