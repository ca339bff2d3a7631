"""Order-dependent folds over the rows of one episode: each step depends on the row kept before it.

Rows that are known to stand alone never reach Python. What is left is cut into stretches, wherever a fold is known to start
afresh, and scanned in order, stretch after stretch, with a state of one row: a stretch is never collected, however long it
is. A scan sees no words, only times and texts; it says which row each row joins, and the words follow in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.config import DEFAULT, EngineConfig
from subtide.functions import words as W
from subtide.operators import ordered

_WORDS = "array<struct<start_ms:bigint,end_ms:bigint,word:string>>"
#: Marks after which a recognised row goes on in the next one.
FRAGMENT = "，、,"


class CleanupState:
    """The row kept last in a stretch. ``step`` takes the next row and says whether it is kept, repeats the kept one while
    that still lasts, or continues it."""

    KEPT, REPEATS, CONTINUES = 0, 1, 2

    def __init__(self, config: EngineConfig = DEFAULT):
        self.config, self.stretch = config, None

    def step(self, stretch: object, start: int, end: int, text: str) -> int:
        c = self.config
        if stretch == self.stretch:
            silence = start - self.end
            if silence <= 0 and text == self.text:
                self.end = max(self.end, end)
                return self.REPEATS
            short = len(self.text) + len(text) <= c.merge_chars and end - self.start <= c.merge_span_ms
            if short and 0 <= silence <= c.merge_gap_ms and self.text[-1] in FRAGMENT:
                self.end, self.text = end, self.text + text
                return self.CONTINUES
        self.stretch, self.start, self.end, self.text = stretch, start, end, text
        return self.KEPT


def _scan(config: EngineConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kept = CleanupState(config), 0
        for batch in batches:
            what, to, upto = [], [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("series", "episode", "label", "position", "start_ms", "end_ms", "text_zh")], strict=True)
            for series, episode, label, position, start, end, text in rows:
                what.append(state.step((series, episode, label), start, end, text))
                kept = position if what[-1] == state.KEPT else kept
                to.append(kept)
                upto.append(state.end)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(what, pa.int32()), pa.array(to, pa.int64()), pa.array(upto, pa.int64())], names=[*batch.schema.names, "what", "kept", "upto"])

    return run


def cleanup(segments: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """series, episode, id, start_ms, end_ms, text_zh, words: repeated overlapping rows merged, fragments joined, ids 1..n.

    Rows are taken in the order of pos (equal ones by start). Texts are trimmed, starts before 0 count as 0; blank rows
    and rows without a positive length are dropped; null words count as none. Where words exist, a row gets their times.
    """
    keys = ["series", "episode"]
    rows = segments.select(*keys, "pos", F.greatest(F.lit(0), F.col("start_ms")).alias("start_ms"), "end_ms", F.trim("text_zh").alias("text_zh"), W.present(F.col("words")).alias("words"))
    rows = rows.filter("text_zh <> '' and start_ms is not null and end_ms > start_ms")
    order = ["pos", "start_ms", "end_ms"]
    near = ordered.neighbours(rows, keys, order, ["start_ms", "end_ms", "text_zh"])

    def may_join(a: Column, b: Column) -> Column:
        """Whether row b can join what was kept up to the row a before it. What was kept ends with a's text, begins no later
        than a and ends no earlier, so limits that a alone breaks are broken."""
        x, y = a["text_zh"], b["text_zh"]
        goes_on = x.rlike(f"[{FRAGMENT}]$") & (F.length(x) + F.length(y) <= config.merge_chars) & (b["end_ms"] - a["start_ms"] <= config.merge_span_ms) & (b["start_ms"] >= a["end_ms"])
        return F.coalesce(goes_on | y.endswith(x), F.lit(False))

    own = F.struct("start_ms", "end_ms", "text_zh")
    here = may_join(F.col("before"), own)
    near = near.withColumns({"joined": here | may_join(own, F.col("after")), "here": here})
    done = ordered.plain(ordered.labels(near, order, ~F.col("here"))).select(*keys, "label", F.col("position").cast("bigint").alias("position"), "start_ms", "end_ms", "text_zh", "words", "joined")
    some = done.filter("joined").drop("joined").withColumn("label", F.coalesce("label", F.lit(0)).cast("bigint"))
    some = some.repartition(*keys, "label").sortWithinPartitions(*keys, "label", "position")
    scanned = some.mapInArrow(_scan(config), f"series string, episode string, label bigint, position bigint, start_ms bigint, end_ms bigint, text_zh string, words {_WORDS}, what int, kept bigint, upto bigint")
    part = F.when(F.col("what") != CleanupState.REPEATS, F.struct("position", "text_zh", "words"))
    merged = scanned.groupBy(*keys, "kept").agg(F.min_by("start_ms", "position").alias("start_ms"), F.max_by("upto", "position").alias("end_ms"), F.array_sort(F.collect_list(part)).alias("parts"))  # as many as merge_chars
    texts, words = F.array_join(F.transform("parts", lambda p: p["text_zh"]), ""), F.flatten(F.transform("parts", lambda p: p["words"]))
    merged = merged.select(*keys, F.col("kept").alias("position"), "start_ms", "end_ms", texts.alias("text_zh"), words.alias("words"))
    alone = done.filter("not joined").select(*keys, "position", "start_ms", "end_ms", "text_zh", "words")
    numbered = ordered.plain(ordered.neighbours(alone.unionByName(merged), keys, ["position"], ["position"]).withColumnRenamed("position", "id"))
    return numbered.select(*keys, F.col("id").cast("bigint").alias("id"), W.span(F.col("start_ms"), F.col("end_ms"), F.col("words")).alias("s"), "text_zh", "words").select(*keys, "id", "s.start_ms", "s.end_ms", "text_zh", "words")


def clip_words(words: Sequence[dict], low: int, high: int | None) -> list[dict]:
    """The words that lie after low and before high, cut to these."""
    cut = [{"start_ms": max(low, w["start_ms"]), "end_ms": w["end_ms"] if high is None else min(high, w["end_ms"]), "word": w["word"]} for w in words]
    return [w for w in cut if w["end_ms"] > w["start_ms"]]


_ROW = ["series", "episode", "id", "start_ms", "end_ms", "text_zh", "words", "recovered"]


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stretch, low = None, 0
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            key = (row["series"], row["episode"], row["label"])
            if key != stretch:
                stretch, low = key, 0
            if row["recovered"] and len(row["words"]):
                words = clip_words([dict(w) for w in row["words"]], low, None if pd.isna(row["high"]) else int(row["high"]))
                if not words:
                    continue
                row |= {"words": words, "start_ms": words[0]["start_ms"], "end_ms": words[-1]["end_ms"], "text_zh": "".join(w["word"] or "" for w in words).strip()}
            if row["end_ms"] > row["start_ms"]:
                out.append([row[c] for c in _ROW])
                low = row["end_ms"]
        yield pd.DataFrame(out, columns=_ROW)


def merge_recovered(segments: DataFrame, recovered: DataFrame) -> DataFrame:
    """series, episode, id, start_ms, end_ms, text_zh, words, recovered: both in the order of (start, id).

    Recovered rows get ids after the episode's largest, in order of start. One with words keeps what lies after the end of the
    row emitted before it and before the start of the next; other rows are kept as they are. Rows without a positive length
    are dropped, also where nothing of a recovered row is left. Only stretches that hold a recovered row are scanned, with a
    state of one row; an original row that isn't near one passes through.
    """
    keys = ["series", "episode"]
    base = segments.filter("start_ms is not null and end_ms > start_ms").select(*keys, F.col("id").cast("bigint").alias("id"), "start_ms", "end_ms", "text_zh", W.present(F.col("words")).alias("words"), F.lit(False).alias("recovered"))
    top = base.groupBy(*keys).agg(F.max("id").alias("__top"))
    new = recovered.filter("start_ms is not null and end_ms > start_ms").select(*keys, "start_ms", "end_ms", "text_zh", W.present(F.col("words")).alias("words"))
    numbered = ordered.plain(ordered.neighbours(new, keys, ["start_ms", "end_ms", "text_zh"], ["start_ms"], 3_600_000)).join(top, keys, "left")
    new = numbered.select(*keys, (F.coalesce("__top", F.lit(0)) + F.col("position")).cast("bigint").alias("id"), "start_ms", "end_ms", "text_zh", "words", F.lit(True).alias("recovered"))
    order = ["start_ms", "id"]
    near = ordered.neighbours(base.unionByName(new), keys, order, ["recovered", "start_ms"], 3_600_000)
    # A stretch begins at an original row: whatever follows depends on its end alone, which no later row changes.
    same = ordered.plain(ordered.labels(near, order, ~F.col("recovered")))
    touches = F.col("recovered") | F.coalesce(F.col("after.recovered"), F.lit(False))
    follow = same.select(*_ROW, F.coalesce("label", F.lit(0)).cast("bigint").alias("label"), F.col("after.start_ms").alias("high"), touches.alias("touches"))
    schema = f"series string, episode string, id bigint, start_ms bigint, end_ms bigint, text_zh string, words {_WORDS}, recovered boolean"
    scanned = follow.filter("touches").drop("touches").repartition(*keys, "label").sortWithinPartitions(*keys, "label", *order).mapInPandas(_merge, schema)
    return follow.filter("not touches").select(*_ROW).unionByName(scanned)
