"""Text as Columns: measures, line balance, times, natural order, entities, signatures."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.config import DEFAULT, EngineConfig
from subtide.functions.columns import let

#: Words that shouldn't end a line, and words that may well begin one.
LINE_END_AVOID = ("a", "an", "the", "of", "in", "on", "at", "to", "from", "with", "for", "by", "into", "my", "your", "his", "her", "our", "their", "is", "are", "was", "were", "must", "can", "will", "would", "has", "have", "had")
LINE_START_GOOD = ("and", "but", "so", "because", "unless", "while", "although")
#: Units that stay with their number.
UNIT_FORMS = ("years?", "days?", "seconds?", "meters?", "miles?", "kg", "km", "percent")
#: Phrases that sound translated.
TRANSLATIONESE = ("Could it be that", "This matter", "You actually dare", "It seems that", "In that case", "Naturally", "Indeed")
#: Suffixes of Chinese names of places, sects and things.
ENTITY_SUFFIXES = ("族", "宗", "宫", "殿", "莲", "剑", "阵", "城", "山", "境")
SENTENCE_END = "[。！？!?]$"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def visible(text: Column) -> Column:
    """Characters that aren't white space, also not U+00A0 or U+3000."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def cps(text: Column, duration_ms: Column) -> Column:
    """Visible characters a second."""
    return visible(text) * F.lit(1000.0) / F.greatest(F.lit(1), duration_ms)


def han(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{3400}-\x{9FFF}]"))


def repeated_character(text: Column) -> Column:
    """One character four times or more in a row."""
    return F.coalesce(text.rlike(r"(?s)(.)\1{3,}"), F.lit(False))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def time_text(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative times count as 0."""
    ms = F.greatest(F.lit(0), ms).cast("bigint")
    return F.concat(
        F.lpad(F.floor(ms / 3600000).cast("string"), F.greatest(F.lit(2), F.length(F.floor(ms / 3600000).cast("string"))), F.lit("0")), F.lit(":"),
        F.lpad(F.floor(ms % 3600000 / 60000).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(ms % 60000 / 1000).cast("string"), 2, "0"), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def time_ms(text: Column) -> Column:
    """The inverse of ``time_text``; null where the text isn't a time."""
    part = lambda i: F.regexp_extract(text, r"^(\d{2,}):(\d{2}):(\d{2}),(\d{3})$", i).cast("bigint")
    return F.when(text.rlike(r"^\d{2,}:\d{2}:\d{2},\d{3}$"), part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4))


def seconds_to_ms(seconds: Column) -> Column:
    """Half to even, as recognisers' seconds become milliseconds."""
    return F.bround(seconds * 1000).cast("bigint")


def _strip(word: Column) -> Column:
    return F.regexp_replace(word, "^[\".,;:!?]+|[\".,;:!?]+$", "")


def boundary_penalty(left: Column, right: Column) -> Column:
    """How bad it is to end a line with ``left`` before ``right``; the first rule that applies counts."""
    bare = _strip(F.lower(left))
    return (
        F.when(bare.isin(*LINE_END_AVOID) | bare.endswith("'s"), 150).when(left.rlike("[.!?]$"), -20).when(left.rlike("[,;:]$"), -10)
        .when(F.lower(right).isin(*LINE_START_GOOD), -8).when(F.lower(left) == "so", 100).otherwise(0)
    )


def _splits(words: Column, score) -> Column:
    """Every way to cut the words in two lines, as struct<score, left, right>."""

    def cut(i: Column) -> Column:
        left, right = F.array_join(F.slice(words, 1, i), " "), F.array_join(F.slice(words, i + 1, F.size(words)), " ")
        return let(F.struct(left.alias("l"), right.alias("r")), lambda s: F.struct(score(s["l"], s["r"], F.get(words, i - 1), F.get(words, i)).alias("score"), s["l"].alias("left"), s["r"].alias("right")))

    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), cut))


NBSP = "\u00a0"  # marks a space at which no line may break


def _spaces(text: Column) -> Column:
    return F.translate(text, NBSP, " ")


def wrap_lines(words: Column, config: EngineConfig = DEFAULT) -> Column:
    """The words as one line, or the best two, joined by a newline; null where no two lines fit."""
    limit, soft = config.line_limit, config.line_soft

    def score(left: Column, right: Column, a: Column, b: Column) -> Column:
        n, m = F.length(left), F.length(right)
        short = F.when(F.least(n, m) < config.line_short, 100).otherwise(0)
        return F.abs(n - m) + short + F.greatest(F.lit(0), n - soft) + F.greatest(F.lit(0), m - soft) + boundary_penalty(a, b)

    def lines(w: Column) -> Column:
        fit = F.filter(_splits(w, score), lambda s: F.greatest(F.length(s["left"]), F.length(s["right"])) <= limit)
        whole = F.array_join(w, " ")
        return F.when(F.length(whole) <= limit, _spaces(whole)).otherwise(let(F.array_min(fit), lambda s: _spaces(F.concat(s["left"], F.lit("\n"), s["right"]))))

    return let(words, lines)


def balance_lines(text: Column, names: Sequence[str] | Column = (), config: EngineConfig = DEFAULT) -> Column:
    """Two lines of about the same length, never failing; ``names`` are kept together."""

    def score(left: Column, right: Column, _a: Column, _b: Column) -> Column:
        n, m = F.length(left), F.length(right)
        return F.abs(n - m) + 10 * F.greatest(F.lit(0), F.greatest(n, m) - config.line_limit) + F.when(F.least(n, m) < config.line_short, 100).otherwise(0)

    plain = squeeze(text)
    kept = keep_together(plain, names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    two = let(F.split(kept, " "), lambda w: let(F.array_min(_splits(w, score)), lambda s: F.when(s.isNull(), _spaces(F.array_join(w, " "))).otherwise(_spaces(F.concat(s["left"], F.lit("\n"), s["right"])))))
    return F.when(F.length(plain) <= config.line_limit, plain).otherwise(two)


def keep_together(text: Column, expressions: Column) -> Column:
    """Replace the spaces inside each expression by no-break spaces, longest first, ties by the text itself."""
    ordered = F.array_sort(F.transform(F.array_distinct(F.filter(expressions, lambda x: x.isNotNull() & (x != ""))), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.aggregate(ordered, text, lambda t, e: F.replace(t, e["x"], F.translate(e["x"], " ", NBSP)))


def layout_words(text: Column, names: Column | None = None) -> Column:
    """The words of a text, with names, capitalised phrases and numbers with their units as one word."""
    plain = squeeze(text)
    phrases = F.regexp_extract_all(plain, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"), F.lit(0))
    units = F.regexp_extract_all(plain, F.lit(r"\b\d+(?:\.\d+)?\s+(?:" + "|".join(UNIT_FORMS) + r")\b"), F.lit(0))
    every = F.concat(*([F.coalesce(names, F.array().cast("array<string>"))] if names is not None else []), phrases, units)
    return F.split(keep_together(plain, every), " ")


def natural_key(name: Column) -> Column:
    """Orders digits by value and the rest by lower case, as an array that compares part by part."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    parts = F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x))


def last_number(name: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), F.lit(-1)).cast("bigint")


def entities_zh(text: Column, suffixes: Sequence[str] = ENTITY_SUFFIXES) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FFF}]{1,8}(?:" + "|".join(suffixes) + ")"), F.lit(0)))


def entities_en(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?:[- ][A-Z][a-z]+){1,7}\b"), F.lit(0)))


def phrase_counts(text: Column, phrases: Sequence[str] = TRANSLATIONESE) -> Column:
    """struct with the number of times that each phrase occurs, without regard to case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda p: ((F.length(low) - F.length(F.replace(low, F.lit(p.lower()), F.lit("")))) / len(p)).cast("bigint")
    return F.struct(*[count(p).alias(p.lower().replace(" ", "_")) for p in phrases])


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC, stripped. Only texts that hold anything but ASCII and basic ideographs reach Python."""
    plain = "^[ -~\\x{4E00}-\\x{9FFF}\\x{3001}\\x{3002}]*$"
    return F.regexp_replace(F.coalesce(_nfkc(F.when(~text.rlike(plain), text)), text), r"(?U)^\s+|\s+$", "")


def signature(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON; arrays among them should be sorted."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def redact(text: Column, secret: str) -> Column:
    """A secret never reaches a sink; an empty secret changes nothing."""
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]")) if secret else text
