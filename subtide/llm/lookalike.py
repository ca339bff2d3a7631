"""One consistent form for texts that look the same (problem 4).

A text is first freed of what a reader can't see: characters that show nothing are dropped, every kind of space becomes
a space, widths and canonical compositions are unified, radicals and compatibility ideographs become the ideograph they
are drawn as. Then each token (a run of letters) is resolved: the scripts in which each of its letters has a spelling
are intersected. A token whose letters come from several scripts, or that as a whole could be spelled in a preferred
script, is written in the first script of the intersection; a token that no single script can spell keeps its letters,
save those that can be written in the script most of it is in.

Plain rows (basic ideographs, ASCII, common marks) never reach Python: ``translate`` is all that they need.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that are drawn alike, Latin first; in each row the letters of Latin, Greek, Cyrillic in order.
ALIKE_LATIN = "ABCEHIJKMNOPSTXYZacehijopsvxyrpiuay"
ALIKE_GREEK = "ΑΒ ΕΗΙ ΚΜΝΟΡ ΤΧΥΖ      ο ν    ριυαγ"
ALIKE_CYRILLIC = "АВСЕНІЈКМ ОРЅТХУ асеһіјорѕѵхуг     "
#: Letters of further scripts (and single ones of these) and the Latin letter they are drawn as, script by script.
ALIKE_MORE = (
    ("ԁԛԝӏӀѡԌҮԚԜ", "dqwlIwGYQW"), ("ɡɑıɩʀϲϹϳ", "gaiiRcCj"), ("օսհոցզյՕՍԼՏ", "ouhngqjOULS"),
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏚᏞᏟᏢᏦᏧᏙᏴ", "DRTiYAJEWMHYGhZbRWSLCPKdVB"), ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc"), ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
)
#: Kana drawn as an ideograph; they count as one only beside ideographs and apart from other kana.
ALIKE_HAN = {"ニ": "二", "ハ": "八", "ロ": "口", "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ヘ": "へ"}
#: Radicals without a decomposition and the ideograph they are drawn as.
RADICALS = {"⺀": "冫", "⺅": "亻", "⺌": "小", "⺍": "小", "⺕": "彐", "⺘": "扌", "⺡": "氵", "⺣": "灬", "⺨": "犭", "⺭": "礻", "⺮": "竹", "⺼": "月", "⻌": "辶", "⻏": "阝", "⻖": "阝", "⻢": "马", "⻥": "鱼", "⻦": "鸟", "⻩": "黄", "⻓": "长", "⻔": "门", "⻋": "车", "⻅": "见", "⻉": "贝", "⻚": "页", "⻛": "风", "⻜": "飞"}
#: Marks that differ in code point alone.
MARKS = {"‐": "-", "‑": "-", "−": "-", "˗": "-", "ʼ": "’", "ꞌ": "’", "․": ".", "‚": ",", "∶": ":", "꞉": ":", "ǃ": "!", "⁄": "/", "∕": "/", "・": "·", "•": "·", "‧": "·", "〜": "~", "∼": "~", "⼀": "一"}

LATIN, GREEK, CYRILLIC = "LATIN", "GREEK", "CYRILLIC"
PREFERENCE = (LATIN, CYRILLIC, GREEK)

_SPELL: dict[str, dict[str, str]] = {}
for _latin, _greek, _cyrillic in zip(ALIKE_LATIN, ALIKE_GREEK, ALIKE_CYRILLIC, strict=True):
    _row = {s: c for s, c in ((LATIN, _latin), (GREEK, _greek), (CYRILLIC, _cyrillic)) if c != " "}
    if _latin in _SPELL:  # one Latin letter may have a look-alike of another script in a second row
        _SPELL[_latin].update({s: c for s, c in _row.items() if s not in _SPELL[_latin]})
        _row = _SPELL[_latin]
    for _c in _row.values():
        _SPELL[_c] = _row
for _letters, _latins in ALIKE_MORE:
    for _c, _latin in zip(_letters, _latins, strict=True):
        _SPELL.setdefault(_c, {**_SPELL.get(_latin, {LATIN: _latin}), "OTHER": _c})

#: What a row may hold and still be plain: ASCII, the basic ideographs, common marks of the script, full-width ASCII.
PLAIN = "^[ -~一-鿿、。…—《》“”‘’「」！-～　\\n\\t]*$"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　\n\t"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + "   "


def _shape(ch: str) -> str:
    """A single code point's visible form: '' where it shows nothing."""
    if ch in RADICALS:
        return RADICALS[ch]
    if ch in MARKS:
        return MARKS[ch]
    category = unicodedata.category(ch)
    if category == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if category in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if category == "Cc":
        return ""
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return unicodedata.normalize("NFKC", ch)
    if tag == "<compat>" and ("⺀" <= ch <= "⿕" or "Ⅰ" <= ch <= "ⅿ" or "ﬀ" <= ch <= "ﬆ" or "Ǆ" <= ch <= "ǳ" or "Ĳ" <= ch <= "ĳ"):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    for script in (LATIN, GREEK, CYRILLIC):
        if name.startswith(script):
            return script
    return "OTHER"


def _resolve(token: list[str]) -> list[str]:
    """Letters (each a base with its marks) of one token in one consistent script."""
    bases = [t[0] for t in token]
    ways = [_SPELL.get(b, {_script(b): b}) for b in bases]
    common = set(ways[0]).intersection(*ways[1:]) if ways else set()
    target = next((s for s in PREFERENCE if s in common), None)
    if target is None and not common:
        own = [_script(b) for b in bases]
        target = max(PREFERENCE, key=lambda s: (sum(o == s and len(w) == 1 for o, w in zip(own, ways, strict=True)), own.count(s), -PREFERENCE.index(s)))
    return [w.get(target, b) + t[1:] for w, b, t in zip(ways, bases, token, strict=True)]


def consistent(text: str) -> str:
    """The consistent form of a text. Case, marks that show and single spaces are kept."""
    text = unicodedata.normalize("NFC", "".join(map(_shape, unicodedata.normalize("NFC", text))))
    # A composed letter hides its base, so tokens are resolved on decomposed letters and composed again.
    out: list[str] = []
    token: list[str] = []
    for ch in unicodedata.normalize("NFD", text):
        if unicodedata.combining(ch) and (token or out):
            if token:
                token[-1] += ch
            else:
                out.append(ch)
        elif ch.isalpha() and _script(ch) != "OTHER" or ch in _SPELL:
            token.append(ch)
        else:
            out += _resolve(token) if token else []
            token = []
            out.append(ch)
    out += _resolve(token) if token else []
    joined = unicodedata.normalize("NFC", "".join(out))
    if any(c in joined for c in ALIKE_HAN):
        joined = "".join(_beside_han(joined, i) for i in range(len(joined)))
    return joined


def _beside_han(text: str, i: int) -> str:
    if text[i] not in ALIKE_HAN:
        return text[i]
    near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
    return ALIKE_HAN[text[i]] if near and all("一" <= c <= "鿿" or not c.isalpha() for c in near) and any("一" <= c <= "鿿" for c in near) else text[i]


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else consistent(t))


def consistent_form(text: Column) -> Column:
    """The consistent form as a Column; null stays null, the empty text empty. Only rows that are not plain reach Python."""
    return F.coalesce(_consistent(F.when(~text.rlike(PLAIN), text)), F.translate(text, _WIDE, _NARROW))


def unify(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with a column <name>_form beside each of ``columns``; equal forms mean texts that look the same."""
    return df.withColumns({f"{c}_form": consistent_form(F.col(c)) for c in columns})


#: So many rows of one class meet in one task when its pairs are written out.
CLASS_PART = 1024


def _members(df: DataFrame, keys: list[str], ident: str, text: str) -> tuple[DataFrame, list[str]]:
    """Rows with a letter or digit: e0..en (the keys, null-safe), id, text, form; and the names of e."""
    names = [f"e{i}" for i in range(len(keys))]
    e = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")).alias(n) for k, n in zip(keys, names, strict=True)]
    rows = df.filter(F.col(text).rlike(r"[\p{L}\p{N}]")).select(*e, F.col(ident).alias("id"), F.col(text).alias("text"))
    return rows.withColumn("form", consistent_form(F.col("text"))), names


def _back(keys: list[str]) -> list[Column]:
    return [F.when(F.col(f"e{i}") != "\0", F.col(f"e{i}")).alias(k) for i, k in enumerate(keys)]


def _classes(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per class with two spellings or more: its size and how many rows hold each spelling, counted before any row
    is moved. A class has few spellings; its rows are never collected."""
    spelt = rows.groupBy(*names, "form", "text").agg(F.count("*").alias("copies"))
    return spelt.groupBy(*names, "form").agg(F.sum("copies").alias("rows"), F.count("*").alias("spellings")).filter("spellings > 1")


def lookalike_classes(df: DataFrame, keys: list[str], ident: str, text: str) -> DataFrame:
    """keys, ident, class (a hash of the consistent form), rows, spellings, links: every row whose text looks like that of
    another row of its key written otherwise. links: the rows of its class that are written otherwise.

    Null texts and texts without a letter or digit are in no class; null keys are a key of their own; repeated rows count each;
    an empty table gives no rows.
    """
    rows, names = _members(df, keys, ident, text)
    spelt = rows.groupBy(*names, "form", "text").agg(F.count("*").alias("copies"))
    found = spelt.join(_classes(rows, names), [*names, "form"])
    joined = rows.join(found.select(*names, "form", "text", "copies", "rows", "spellings"), [*names, "form", "text"])
    return joined.select(*_back(keys), F.col("id").alias(ident), F.xxhash64("form").alias("class"), "rows", "spellings", (F.col("rows") - F.col("copies")).alias("links"))


def lookalike_pairs(df: DataFrame, keys: list[str], ident: str, text: str) -> DataFrame:
    """keys, id_a, id_b: rows of one key whose texts look the same but differ in code points, id_a < id_b.

    Classes with two texts or more are found by hash aggregates, and only their rows are joined, on the class. A large class is
    spread: one side of its join is cut into parts of about ``CLASS_PART`` rows, each of which meets the other side in a task of
    its own. Null texts and texts without a letter or digit are in no class. The key columns are compared null-safely. The number
    of pairs is the result's own size; exact copies add no class.
    """
    rows, names = _members(df, keys, ident, text)
    classes = _classes(rows, names).select(*names, "form", F.ceil(F.col("rows") / CLASS_PART).cast("int").alias("parts"))
    members = rows.join(classes, [*names, "form"])
    a = members.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.col("parts")).cast("int")).drop("parts")
    b = members.select(*names, "form", F.col("id").alias("id_b"), F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, [*names, "form", "part"]).filter("id < id_b and text <> text_b")
    return pairs.select(*_back(keys), F.col("id").alias("id_a"), "id_b")
