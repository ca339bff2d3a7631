"""Strict contracts of model replies. Spark's JSON readers are lenient, so the checks run in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ITEM = T.StructType([T.StructField("id", T.LongType()), T.StructField("en", T.StringType())])
REPLY = T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("items", T.ArrayType(_ITEM))])
COMPLETION = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "content", "finish")])
FENCE = "```"


def completion(raw: str | None) -> tuple[str, str | None, str | None]:
    """(status, content, finish) of one response body: a single JSON document, after which only ``data: [DONE]`` may come."""
    if raw is None or not raw.strip():
        return "empty", None, None
    body = raw.strip()
    try:
        document, end = json.JSONDecoder().raw_decode(body)
    except ValueError:
        return "parse", None, None
    if body[end:].strip() not in ("", "data: [DONE]"):
        return "parse", None, None
    try:
        choice = document["choices"][0]
        content, finish = choice["message"]["content"], choice.get("finish_reason")
    except (KeyError, IndexError, TypeError, AttributeError):
        return "parse", None, None
    if finish == "length":
        return "length", None, finish
    if not isinstance(content, str) or not content.strip():
        return "empty", None, finish
    return "ok", content, finish


def reply(content: str | None, ids: list[int]) -> tuple[str, str | None, list[dict] | None]:
    """(status, reason, items): the translations of the targets, in their order, and nothing else."""
    if content is None or not content.strip():
        return "empty", "blank", None
    body = content.strip()
    if body.startswith(FENCE):
        if not (body.startswith(FENCE + "json\n") and body.endswith("\n" + FENCE)):
            return "parse", "fence", None
        body = body[len(FENCE) + 5 : -len(FENCE) - 1]
    try:
        document = json.loads(body)
    except ValueError:
        return "parse", "json", None
    if not isinstance(document, dict) or set(document) != {"translations"} or not isinstance(document["translations"], list):
        return "parse", "root", None
    items = document["translations"]
    if len(items) != len(ids):
        return "parse", "count", None
    for item, wanted in zip(items, ids, strict=True):
        if not isinstance(item, dict) or set(item) != {"id", "en"}:
            return "parse", "keys", None
        if type(item["id"]) is not int or item["id"] != wanted:
            return "parse", "id", None
        if not isinstance(item["en"], str) or not item["en"].strip():
            return "parse", "text", None
    return "ok", None, [{"id": i["id"], "en": i["en"]} for i in items]


@F.pandas_udf(COMPLETION)
def parse_completion(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([completion(r) for r in raw], columns=["status", "content", "finish"])


@F.pandas_udf(REPLY)
def validate_reply(content: pd.Series, ids: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([reply(c, [] if i is None else [int(x) for x in i]) for c, i in zip(content, ids, strict=True)], columns=["status", "reason", "items"])


def request(targets: Column, previous: Column, following: Column, glossary: Column) -> Column:
    """The JSON text of one request."""
    return F.to_json(F.struct(glossary.alias("glossary"), previous.alias("previous_context"), following.alias("following_context"), targets.alias("targets")))


def dead_letters(results: DataFrame, secret: str = "") -> DataFrame:
    """Rows whose status isn't ok, without the secret in any text column."""
    bad = results.filter(~F.col("status").eqNullSafe("ok"))
    if not secret:
        return bad
    return bad.select(*[F.replace(F.col(f"`{f.name}`"), F.lit(secret), F.lit("[REDACTED]")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in bad.schema])
