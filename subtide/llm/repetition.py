"""Repetition inside one document (problem 3): a threshold table compiled into one projection.

All measures are built-in expressions over the row itself: there is no shuffle and no user function. Shares of repeated
content are measured on the letters and digits alone, and count what lies in second or later copies:

* a unit of up to ``UNIT`` letters said three times or more on end is reduced to its first copy (one replacement by a
  regular expression); a word that merely comes up again elsewhere is thus no copy;
* in what is left, passages of ``PHRASE`` letters that occur before, and passages of ``NEAR`` letters that occur before
  with at most one inner letter replaced, are copies where they don't overlap the earlier one. Longer copies, with any number
  of changes that are ``NEAR`` letters apart, are unions of such passages.

Two passages with one replacement share an exact half, so a row without a repeated half has no copies beyond the first
kind. In other rows each inner place is masked in turn and the passages sorted: every copy, and nothing else, stands next to
passages that are equal but for that place. Sorting keeps the work near-linear in the length of a text, so long texts need no cut.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.columns import let

UNIT, PHRASE, NEAR = 3, 4, 6
#: Letters and digits that a text must have to count as repeating itself.
LEAST = 12
#: Function words, by which running text differs from lists and noise.
STOP_WORDS = ("的", "了", "是", "在", "我", "你", "他", "不", "这", "那", "也", "就", "都", "和", "把", "吗", "the", "a", "of", "to", "and", "in", "is", "you", "i", "it", "that", "for", "on", "was")
OPERATORS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


@dataclass(frozen=True)
class Rule:
    """flag: every condition (measure, operator, bound) holds. Conditions are asked in order, so the cheap ones come first."""

    flag: str
    conditions: tuple[tuple[str, str, float], ...]


#: The threshold table. A measure is a column of ``measures``.
RULES = (
    Rule("repeated_lines", (("length", ">=", LEAST), ("repeated_line_share", ">", 0.5))),
    Rule("mostly_repeated", (("length", ">=", LEAST), ("repeated_share", ">", 0.5))),
    Rule("mostly_symbols", (("length", ">=", 1), ("symbol_share", ">", 0.6))),
    Rule("no_function_words", (("length", ">=", 60), ("stop_word_share", "<", 0.01))),
)
#: The flags that say that a text consists mostly of repeated content.
REPEATED = ("repeated_lines", "mostly_repeated")


def plain(text: Column) -> Column:
    """Letters and digits, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def repeated_length(plain_text: Column, phrase: int = PHRASE, near: int = NEAR, unit: int = UNIT) -> Column:
    """Characters of ``plain_text`` that lie in second or later copies."""

    def grams(chars: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.array_join(F.slice(chars, i + 1, n), ""))

    def copies(passages: Column, n: int, key) -> Column:
        """Places in the passages of ``n`` letters that occur before; ``key``: what of a passage must be equal."""
        keys = F.sort_array(F.transform(passages, lambda w, i: F.struct(key(w).alias("g"), i.alias("i"))))

        def later(s: Column) -> Column:
            def is_copy(x: Column, m: Column) -> Column:
                # At most n - 1 of the equal ones before it overlap it, so of ``n`` one doesn't, or none does.
                earlier = lambda b: (F.get(s, m - b)["g"] == x["g"]) & (F.get(s, m - b)["i"] <= x["i"] - n)
                return (m > 0) & (F.get(s, m - 1)["g"] == x["g"]) & F.exists(F.sequence(F.lit(1), F.lit(n)), earlier)

            return F.flatten(F.transform(F.filter(s, is_copy), lambda x: F.sequence(x["i"], x["i"] + n - 1)))

        return let(keys, later)

    def covered(chars: Column) -> Column:
        exact = let(grams(chars, phrase), lambda g: copies(g, phrase, lambda w: w))
        masked = let(grams(chars, near), lambda g: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(near - 2)), lambda k: F.array_distinct(copies(g, near, lambda w: F.concat(F.substr(w, F.lit(1), k), F.substr(w, k + 2, F.lit(near))))))))
        return F.size(F.array_distinct(F.concat(exact, F.when(F.size(chars) >= 2 * near, masked).otherwise(F.array().cast("array<int>")))))

    def measured(chars: Column) -> Column:
        repeats = let(grams(chars, near // 2), lambda g: F.size(F.array_distinct(g)) < F.size(g))
        return F.when(repeats, covered(chars)).otherwise(0)

    def of(once: Column) -> Column:
        return F.length(plain_text) - F.length(once) + F.when(F.length(once) >= 2 * phrase, let(characters(once), measured)).otherwise(0)

    return let(F.regexp_replace(plain_text, rf"(?s)(.{{1,{unit}}}?)\1{{2,}}", "$1"), of)


def repeated_line_length(text: Column) -> Column:
    """Letters and digits of sentences and lines that occurred before in the text."""

    def measured(lines: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
        return total(lines) - total(F.array_distinct(lines))

    lines = F.filter(F.transform(F.split(text, r"[\n。！？!?.;；]+"), plain), lambda x: x != "")
    return let(lines, measured)


#: Every measure, in the order in which they are given out.
MEASURES = ("length", "symbol_share", "stop_word_share", "repeated_line_share", "repeated_share")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _measure(name: str, text: Column, p: Column) -> Column:
    """One measure of ``text``, of which ``p`` are the letters and digits."""
    if name == "length":
        return F.length(p)
    if name == "symbol_share":
        return let(F.length(F.regexp_replace(text, r"(?U)\s", "")), lambda shown: _share(shown - F.length(p), shown))
    if name == "stop_word_share":
        words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[㐀-鿿]|[\p{L}\p{N}]+"), F.lit(0)), lambda x: x != "")
        return let(words, lambda w: _share(F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))), F.size(w)))
    if name == "repeated_line_share":
        return _share(repeated_line_length(text), F.length(p))
    return _share(repeated_length(p), F.length(p))


def measures(text: Column) -> Column:
    """A struct with every measure. Null and empty texts measure 0."""
    text = F.coalesce(text, F.lit(""))
    return let(plain(text), lambda p: F.struct(*[_measure(name, text, p).alias(name) for name in MEASURES]))


def flags(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The flags of the rules of which every condition holds, in the order of the table.

    The table becomes one expression: a rule is a conjunction, so a measure is worked out only for texts that meet the
    conditions before it. Null and empty texts raise nothing.
    """
    text = F.coalesce(text, F.lit(""))

    def compiled(p: Column) -> Column:
        raised = []
        for rule in rules:
            holds = F.lit(True)
            for measure, op, bound in rule.conditions:
                holds = holds & OPERATORS[op](_measure(measure, text, p), F.lit(bound))
            raised.append(F.when(holds, F.lit(rule.flag)))
        return F.array_compact(F.array(*raised))

    return let(plain(text), compiled)


def spoken(words: Column) -> Column:
    """The words of a segment put together; null words add nothing."""
    return F.array_join(F.transform(words, lambda w: F.coalesce(w["word"], F.lit(""))), "")


def _other_words(text: Column, words: Column) -> Column:
    """The words put together, null where they spell the same letters and digits as the text."""
    said = F.coalesce(spoken(words), F.lit(""))
    return F.when(plain(said) != plain(F.coalesce(text, F.lit(""))), said)


def flagged(df: DataFrame, ident: str, text: str, words: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """ident and the flags that the text or the words raise: the whole table in one projection over the input.

    Null or empty texts raise nothing; repeated rows are measured each; other columns are not read. Words that spell the
    same letters and digits as the text are not measured twice.
    """
    raised = flags(F.col(text), rules)
    if words is not None:
        none = F.array().cast("array<string>")
        raised = F.array_union(raised, let(_other_words(F.col(text), F.col(words)), lambda o: F.when(o.isNotNull(), flags(o, rules)).otherwise(none)))
    return df.select(F.col(ident), raised.alias("flags"))


def repetition(df: DataFrame, ident: str, text: str, words: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """ident, every measure of ``text``, repeated_share_words (null words: that of the text), and the flags; otherwise as ``flagged``."""
    m = measures(F.col(text))
    own = flags(F.col(text), rules)
    if words is None:
        return df.select(F.col(ident), m.alias("m"), own.alias("flags")).select(ident, "m.*", F.col("m.repeated_share").alias("repeated_share_words"), "flags")
    other = _other_words(F.col(text), F.col(words))
    both = let(other, lambda o: F.when(o.isNotNull(), F.struct(let(plain(o), lambda p: _share(repeated_length(p), F.length(p))).alias("share"), flags(o, rules).alias("flags"))))
    out = df.select(F.col(ident), m.alias("m"), own.alias("f"), both.alias("w"))
    return out.select(ident, "m.*", F.coalesce("w.share", "m.repeated_share").alias("repeated_share_words"), F.when(F.col("w").isNull(), F.col("f")).otherwise(F.array_union("f", "w.flags")).alias("flags"))
