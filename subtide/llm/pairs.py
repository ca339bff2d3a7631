"""Broken prompt and response pairs (problem 2): ordered rules over a source sentence and its answer.

The rules are expressions over the pair. Two of them ask the corpus, through aggregates over all rows:

* abrupt endings: how sentences end is learnt from the answers that do end with a stop. An answer without one is
  complete only if its last word has been seen at the end of answers to sources that end alike.
* script mismatch within one script: which words are English is learnt from the company they keep. Only answers whose
  words are mostly unknown to a short list of English function words ask for it.

Both models are aggregates keyed by word, counted before they are shuffled; rows meet them in shuffle joins on salted keys,
so a word or an ending that a third of all rows share is spread over tasks, nothing grows on the driver, and only the rows
that a plain rule can't decide take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.functions.columns import let, strict_or
from subtide.session import durable

ORDER = ("empty", "refusal", "copy", "truncated", "wrong_language")
#: Into so many parts the rows of one word or ending are spread.
SALT = 8

#: Words that mark a text as English. The first list is strong: no other language uses them.
STRONG = tuple("the of you is are was were will would have has had this that these with for my your his her their its from what who where why which when been they we she he it's i'll i'm can't won't don't never there has and not shall could should".split())
COMMON = STRONG + tuple(
    "a an i it in on at to by as be do no so if or but me him them us our up out all any some one two three ten now then than how here go going gone come came coming get got let lets let's look see saw run stop wait open close hold stand sit help hurry quick quickly please thank thanks yes yeah oh ah ha haha hm hmm mm well good great bad ok okay right left back down over under again once just only even still very too much many more most last next long ago late soon later year years day days night time end song chapter episode part master sir lord lady father mother brother sister friend king sword nobody somebody everyone everything nothing alive dead die lies says said tell told know think want need take give make made find leave leaves left fire kill careful amusing funny interesting strange true false sorry hello goodbye farewell dear love hate fight enough indeed perhaps maybe because about after before between into through without within off away".split()
)
#: Words of the first list that other languages spell too.
SHARED = tuple("was will he she not".split())
#: Particles that may end a Chinese sentence without changing what it says.
PARTICLES = "[啊呢吧嘛呀啦哦哟么]+$"
#: Words after which an English sentence can't end.
DANGLING = tuple("the a an of to at in on for with from by and or but as my your his her its their our this these is are was were be been has have had will would can could should may might must not than that who which where when why how if because about into under every another very".split())
#: How refusals speak, by language: a stem that names translating or answering, and a negation.
REFUSAL = (
    r"\b(cannot|can't|can not|could not|couldn't|unable to|not able to|won't|will not|must|have to|need to|refus\w+|decline[ds]?|declining|rather not|not comfortable|(do not|don't) feel comfortable|not (permitted|allowed))\b.{0,60}\b(translat\w*|render|into english|this (request|line|text|sentence|content|passage|target|prompt)|your request|the request|assist with|comply|guess at)",
    r"\b(translat\w+|this (line|text|sentence|content|passage|target|request)|request)\b.{0,50}\b(cannot|can't|could not|declined|refused|withheld|unavailable|not available|not provided|not possible|outside what i can|blocked|omitted|violates)",
    r"\bno (english )?translation\b|\bas an? (ai|artificial|(large )?language model|assistant)\b|\b(content|safety) (policy|policies|filter|guidelines?)\b|\boutside what i can\b|\bmore context\?",
    r"(无法|不能|不予|不会|不可以|拒绝|不便|没法|未能|難以|难以|無法).{0,12}(翻译|翻譯|译出|译成|处理|處理|协助|回答|请求|提供)|(翻译|翻譯|请求|内容).{0,10}(被拒|拒绝|无法|不予|不能|违规)|作为.{0,6}(语言模型|人工智能|助手)|作為.{0,6}(語言模型|人工智慧)",
    r"翻訳.{0,14}(できません|できない|いたしかねます|お断り|控え)|お手伝いできません|お答えできません|対応できません",
    r"번역.{0,14}(할 수 없|해 드릴 수 없|드릴 수 없|불가|거부|제공)|도와드릴 수 없",
    r"\b(no|non|não|ne|nicht|kein\w*|nie|not)\b.{0,40}(tradu\w+|übersetz\w*)|(tradu\w+|übersetz\w*).{0,40}\b(no|non|não|pas|nicht|impossible|imposible|verweigert|refusée?|rechazada)\b",
    r"(не (могу|можем|удалось|буду)|невозможно|нельзя|отказ).{0,30}(перев|запрос|выполн)|перевод.{0,30}(невозможен|недоступен|отклон)",
    r"không (thể|được).{0,25}(dịch|yêu cầu|hỗ trợ)|tidak (dapat|bisa|boleh).{0,25}(terjemah|menerjemah|memenuhi|membantu)|(çevir|tercüme).{0,20}(em|mıyor|miyor|reddedildi|mümkün değil)",
)
#: Each pattern above needs one of these.
REFUSAL_STEMS = tuple("translat render english request line text sentence content passage target prompt assist comply guess artificial language context outside 译 譯 处理 處理 协助 回答 请求 提供 内容 模型 智能 智慧 助手 翻訳 お手伝い お答え 対応 번역 도와 tradu übersetz перев запрос выполн dịch yêu hỗ terjemah menerjemah memenuhi membantu çevir tercüme".split())
#: What an answer that merely hands back the source may put around it.
WRAPPERS = r"(?i)\b(translate|translated?|translation|source|original|text|line|sentence|chinese|english|input|output|answer|response|please|the|this|is|of|into|to|following|zh|en)\b|原文|译文|翻译|中文|英文|如下|这句话|请"

LETTERS = r"[^\p{L}\p{N}]"
INVISIBLE = r"[\p{Cf}\x{00AD}]"
STOP = "[.!?…。！？][\"'”’)\\]»」』】]*$"


def bare(text: Column) -> Column:
    """Letters and digits, lower case."""
    return F.lower(F.regexp_replace(text, LETTERS, ""))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+(?:['’][\p{L}]+)?"), F.lit(0))


def features(df: DataFrame, ident: str, source: str, answer: str) -> DataFrame:
    """One row per input row with what the rules look at."""
    src = F.regexp_replace(F.coalesce(F.col(source), F.lit("")), INVISIBLE, "")
    en = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), INVISIBLE, ""), r"(?U)\s+", " ")
    out = df.select(F.col(ident).alias("id"), F.trim(src).alias("src"), F.trim(en).alias("en"))
    out = out.withColumns({"src_bare": bare(F.col("src")), "en_bare": bare(F.col("en"))})
    shouted = (F.col("en") == F.upper("en")) & (F.length("en_bare") > 12)
    return out.withColumns({
        "han": _count(F.col("en_bare"), r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"),
        "latin": _count(F.col("en_bare"), r"\p{IsLatin}"),
        "letters": _count(F.col("en_bare"), r"\p{L}"),
        "stopped": F.col("en").rlike(STOP),
        "src_stopped": F.col("src").rlike(STOP),
        "src_open": F.col("src").rlike(r"(…|—|——|\.\.\.|-)[”’」』]*$"),
        "en_open": F.col("en").rlike("(…|—|\\.\\.\\.|--|-)[\"'”’)]*$"),
        "words": _words(F.when(shouted, F.lower("en")).otherwise(F.col("en"))),
    })


def _unclosed() -> Column:
    """A bracket or a quotation that is opened and not closed."""
    en = F.col("en")
    n = lambda p: _count(en, p)
    return en.rlike('["“(（\\[{《「『]') & strict_or(n('"') % 2 == 1, n("[“]") > n("[”]"), n("[(（]") > n("[)）]"), n(r"[\[]") > n(r"[\]]"), n("[{]") > n("[}]"), n("[《]") > n("[》]"), n("[「『]") > n("[」』]"))


def _copy() -> Column:
    """The answer is the source: whole, or near enough, or a long part of its beginning, whatever is put around it."""
    src, en = F.col("src_bare"), F.col("en_bare")
    has_han = src.rlike(r"[\x{3400}-\x{9FFF}]")
    rest = F.regexp_replace(F.lower(F.col("en")), WRAPPERS, "")
    left = F.length(F.replace(bare(rest), src, F.lit("")))
    whole = en.contains(src) & (left <= F.greatest(F.lit(2), F.length(src) * 0.4))
    near = (F.abs(F.length(en) - F.length(src)) <= F.length(src) * 0.2) & (F.length(src) >= 4) & (F.levenshtein(en, src, 3) >= 0) & (F.levenshtein(en, src, 3) <= F.length(src) * 0.2)
    prefix = (F.length(en) >= 4) & (F.length(en) >= F.length(src) * 0.5) & src.startswith(en)
    return has_han & (F.length(src) > 0) & (F.col("han") > 0) & strict_or(whole, near, prefix)


def _refusal() -> Column:
    """Not where the source itself speaks of translating, and not a copy of it."""
    spoken = lambda en: strict_or(*[en.contains(w) for w in (*REFUSAL_STEMS, "as a")]) & strict_or(*[en.rlike(p) for p in REFUSAL])
    said = let(F.lower(F.translate("en", "’", "'")), spoken)
    return said & ~F.col("src").rlike("译|譯|语言模型") & (F.col("en_bare") != F.col("src_bare"))


def _last_word(words: Column) -> Column:
    """The last word of an answer; a name counts as a name, whichever it is."""
    w = F.element_at(words, -1)
    return F.when(F.size(words) == 0, "").when((F.size(words) > 1) & w.rlike(r"^\p{Lu}"), "<Name>").otherwise(F.lower(w))


def _zh_end(n: int) -> Column:
    """The last n letters of the source, without final particles."""
    return F.substring(F.regexp_replace("src_bare", PARTICLES, ""), -n, n)


def _endings(rows: DataFrame) -> DataFrame:
    """(zh2, word) that rows ask for, with: of2, n2 and n1 (how often sources that end in zh2, in zh2 and in its last letter are
    answered by a finished sentence, with this last word for the latter two), n0 (the same whatever the source), and caption
    (the last word that most answers without a stop share whose sources end in zh2 and lack theirs too).

    Rows are counted by ending and word first; after that a word has at most one row per pair of letters.
    """
    usable = F.col("han") == 0
    latin = F.col("latin") * 2 > F.col("letters")
    finished = F.col("stopped") & ~F.col("en_open") & usable & latin & F.col("en").like("% %")
    caption = ~F.col("stopped") & ~F.col("src_stopped") & ~F.col("src_open") & usable & latin
    counted = rows.filter(finished | caption | F.col("asks")).groupBy(F.col("zh2"), F.col("word")).agg(F.count_if(finished & (F.col("word") != "")).alias("n2"), F.count_if(caption).alias("captions"), F.count_if("asks").alias("asked"))
    by_word, by_last, by_end = Window.partitionBy("word"), Window.partitionBy("word", F.right("zh2", F.lit(1))), Window.partitionBy("zh2")
    counted = counted.withColumns({"n0": F.sum("n2").over(by_word), "n1": F.sum("n2").over(by_last)})
    counted = counted.withColumns({"of2": F.sum("n2").over(by_end), "of": F.sum("captions").over(by_end), "most": F.max(F.struct("captions", "word")).over(by_end)})
    return counted.filter("asked > 0").select("zh2", "word", "of2", "n2", "n1", "n0", F.when(F.col("most.captions") * 2 > F.col("of"), F.col("most.word")).alias("caption"))


def _salted(table: DataFrame) -> DataFrame:
    """A table with one row per key, once for every salt."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def usual_length(rows: DataFrame) -> float:
    """The median number of letters of an answer per character of its source, one number over all rows."""
    usable = rows.filter("stopped and han = 0 and latin * 2 > letters and length(src_bare) >= 6")
    found = usable.agg(F.percentile_approx(F.length("en_bare") / F.length("src_bare"), 0.5, 1000)).first()[0]
    return float(found) if found else 3.5


def _lexicon(rows: DataFrame) -> DataFrame:
    """word, english: the share of the answers with the word that also hold another word that only English has."""
    words = F.array_distinct(F.transform("words", lambda w: F.lower(w)))
    only = [w for w in STRONG if w not in SHARED]
    strong = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in only])))
    exploded = rows.filter("latin > 0").select(words.alias("w"), strong.alias("strong")).select(F.explode("w").alias("word"), "strong")
    own = F.when(F.col("word").isin(*only), 1).otherwise(0)
    return exploded.groupBy("word").agg(F.avg(F.when(F.col("strong") - own >= 1, 1.0).otherwise(0.0)).alias("english"))


def broken_pairs(df: DataFrame, ident: str, source: str, answer: str) -> DataFrame:
    """ident, defects (every defect whose rule is triggered, in the order of ORDER), defect (the one that the row is called by;
    a foreign sentence isn't called truncated for how English ones end); sound rows are left out.

    ident must tell rows apart. A null answer counts as empty, a null source as one without letters, for which no answer
    is empty and none is a copy; such rows can still be refusals, cut off or in another language. Each row is judged
    on its own, so repeated rows are each reported; columns other than the three are not read; an empty table gives
    no rows.
    """
    rows = features(df, ident, source, answer)
    empty = F.length(F.regexp_replace("en", LETTERS, "")) == 0
    rows = rows.withColumns({
        "empty": empty & (F.length("src_bare") > 0),
        "refusal": ~empty & _refusal(),
        "copy": ~empty & _copy(),
        "unclosed": ~empty & _unclosed(),
        "comma": F.col("en").rlike("[,;:，；：、][\"'”’)]*$") & ~F.col("src").rlike("[,;:，；：、][”’]*$"),
    })

    # Script and language: other scripts by count, other languages in Latin letters by their words.
    inner = F.filter("words", lambda w: ~w.rlike(r"^\p{Lu}"))
    known = F.size(F.filter(inner, lambda w: F.lower(F.translate(w, "’", "'")).isin(*COMMON)))
    rows = rows.withColumns({
        "script": ~empty & (F.col("letters") > 0) & (F.col("latin") * 2 < F.col("letters")),
        "inner": F.size(inner),
        "known": known,
    })
    # Endings: answers without a stop, and very short ones, ask how sources that end like theirs are answered. A source
    # that lacks its stop, or ends in a comma, is judged as well; only one that is left open itself spares its answer.
    # Captions ("The End", "Chapter 3: Xuanming") and their sources have no stop: they end as others of their kind.
    rows = rows.withColumns({"zh2": _zh_end(2), "word": _last_word(F.col("words")), "salt": F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"), "ratio": F.length("en_bare") / F.when(F.length("src_bare") >= 6, F.length("src_bare"))})
    rows = durable(rows)  # what the rules look at is worked out once; the steps below use it
    usual = usual_length(rows)
    ratio, judged = F.col("ratio"), F.col("src_stopped") | (~F.col("stopped") & ~F.col("src_open"))
    asks = ~F.col("empty") & ~F.col("unclosed") & (~F.col("stopped") | F.coalesce(ratio < usual * 0.7, F.lit(False))) & (F.col("han") == 0) & (F.col("latin") * 2 > F.col("letters")) & judged & F.col("en").contains(" ")
    rows = rows.withColumn("asks", asks)
    whole = (F.length("src_bare") < 6) & (F.length("en_bare") >= F.length("src_bare") * usual * 0.8)
    heading = F.col("src").rlike(r"[\s\d:：]") & ~F.col("src").rlike("[,，。、;；!！?？…]") & (F.col("word") == "<Name>")
    titled = ~F.col("src_stopped") & (whole | heading)
    brief = F.coalesce(ratio < usual * 0.8, F.lit(False))
    unseen = F.when(F.col("of2") >= 8, F.col("n2") == 0).otherwise((F.col("n0") == 0) | ((F.col("n1") == 0) & brief))
    unseen = unseen & ~F.coalesce(titled & (F.col("word") == F.col("caption")), F.lit(False))

    # Languages in Latin letters: words that the short list doesn't hold ask what company they keep.
    doubtful = (F.col("latin") * 2 >= F.col("letters")) & (F.size("words") >= 2) & (F.col("inner") >= 1) & (F.col("known") * 2 < F.col("inner"))
    lower = F.transform(inner, lambda w: F.lower(w))
    asked = rows.filter(doubtful).select("id", "salt", lower.alias("all"), F.explode_outer(F.filter(lower, lambda w: ~w.isin(*COMMON))).alias("lone"))
    answered = asked.join(_salted(_lexicon(rows)).withColumnRenamed("word", "lone"), ["lone", "salt"], "left").groupBy("id").agg(
        F.count_if(F.col("english") >= 0.3).alias("learnt"), F.count("lone").alias("lone"), F.max(F.size("all")).alias("n")
    )
    sure = (F.col("learnt") + F.col("n") - F.col("lone")) / F.col("n")
    foreign = answered.select("id", ((sure < 0.35) & (F.col("n") >= 2)).alias("foreign_words"), ((sure == 0) & (F.col("n") == 1)).alias("foreign_word"))

    endings = _salted(_endings(rows)).withColumnRenamed("zh2", "zh2_").withColumnRenamed("word", "word_").withColumnRenamed("salt", "salt_")
    met = F.col("asks") & (F.col("zh2") == F.col("zh2_")) & (F.col("word") == F.col("word_")) & (F.col("salt") == F.col("salt_"))
    rows = rows.join(endings, met, "left").withColumn("unseen", F.when(F.col("asks"), unseen)).join(foreign, "id", "left")

    last = F.lower(F.element_at("words", -1))
    short = F.coalesce(ratio < usual * 0.45, F.lit(False)) & (F.col("latin") * 2 > F.col("letters")) & (F.col("han") == 0)
    excused = F.col("src_open") & (F.col("en_open") | (F.length("src_bare") < 4))
    dangling = ~F.col("stopped") & (F.size("words") >= 2) & last.isin(*DANGLING) & judged & F.coalesce(F.col("unseen"), F.lit(True))
    foreign_any = strict_or(F.col("foreign_words"), F.col("foreign_word") & F.col("en").rlike(r"[^\x00-\x7F]"))
    named = {
        "empty": F.col("empty"),
        "refusal": F.col("refusal"),
        "copy": F.col("copy"),
        "truncated": ~F.col("empty") & ~excused & strict_or(F.col("unclosed"), F.col("comma"), dangling, F.col("unseen"), short),
        "wrong_language": ~F.col("empty") & strict_or(F.col("script"), foreign_any),
    }
    # What a row is called first. How English sentences end, and how long they are, says nothing of a foreign one.
    plainly = named["truncated"] & ~F.col("script") & strict_or(F.col("unclosed"), F.col("comma"), ~foreign_any)
    first = F.when(named["empty"], "empty").when(named["refusal"], "refusal").when(named["copy"], "copy").when(plainly, "truncated").when(named["wrong_language"], "wrong_language")
    defects = F.array_compact(F.array(*[F.when(F.coalesce(named[d], F.lit(False)), F.lit(d)) for d in ORDER]))
    return rows.select(F.col("id").alias(ident), defects.alias("defects"), first.alias("defect")).filter("defect is not null")
