"""Dictionary lookup, the translation memory, and the learning of terms, keyed by series."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.config import DEFAULT, EngineConfig
from subtide.functions import text as X

#: Who decides on a term, strongest first. Only the first three bind a translation.
AUTHORITIES = ("manual", "locked", "confirmed", "local", "candidate")
HARD = AUTHORITIES[:3]
#: Up to so many terms a series' dictionary is one pattern; beyond, a trie in Arrow batches.
PATTERN_TERMS = 1000


def latest_by(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Last writer wins; a null key part is a value of its own; equal orders are settled by the row's hash."""
    tie = F.xxhash64(*df.columns)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), tie)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_by(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """First writer wins."""
    tie = F.xxhash64(*df.columns)
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), tie)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    return latest_by(old.unionByName(new, allowMissingColumns=True), keys, order)


def insert_first(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """``old`` and those of ``new`` whose key is not in it, each key once."""
    return old.unionByName(first_by(new, keys, order).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def candidate_counts(occurrences: DataFrame) -> DataFrame:
    """series, source, en, n: over occurrences deduplicated first-wins by (series, episode, cue, source)."""
    return first_by(occurrences, ["series", "episode", "cue", "source"]).groupBy("series", "source", "en").agg(F.count("*").alias("n"))


def observe(occurrences: DataFrame, terms: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The deduplicated occurrences with what learning made of each: established (the rendering that held before the
    row, null while there is none), promotes, conflict.

    A source with no term is established at the first row at which all its renderings so far agree and
    ``promote_after`` of its occurrences are not suspect; that is when the third trusted row comes before any second
    rendering. All of it is aggregates by source: positions of the third trusted row and of the first deviating one.
    """
    rows = first_by(occurrences, ["series", "episode", "cue", "source"])
    known = (latest_by(terms, ["series", "source"], "term_id") if "term_id" in terms.columns else terms).filter("en is not null").select("series", "source", F.col("en").alias("__term")) if terms is not None else None
    # Per source: its first rendering, the place of the first other one, and the promote_after smallest trusted places.
    first = rows.groupBy("series", "source").agg(F.min_by("en", "seq").alias("__first_en"))
    rows = rows.join(first, ["series", "source"])
    trusted = F.when(~F.coalesce("suspect", F.lit(False)), F.col("seq"))
    other = F.when(~F.col("en").eqNullSafe(F.col("__first_en")), F.col("seq"))
    by_rank = Window.partitionBy("series", "source").orderBy("seq")
    third = (
        rows.filter(trusted.isNotNull()).select("series", "source", "seq", F.row_number().over(by_rank).alias("r")).filter(F.col("r") <= config.promote_after)
        .groupBy("series", "source").agg(F.max(F.when(F.col("r") == config.promote_after, F.col("seq"))).alias("__third"))
    )
    deviates = rows.groupBy("series", "source").agg(F.min(other).alias("__other"))
    rows = rows.join(third, ["series", "source"], "left").join(deviates, ["series", "source"], "left")
    at = F.when(F.col("__third").isNotNull() & (F.col("__other").isNull() | (F.col("__third") < F.col("__other"))) & F.col("__first_en").isNotNull(), F.col("__third"))
    if known is not None:
        rows = rows.join(known, ["series", "source"], "left")
    else:
        rows = rows.withColumn("__term", F.lit(None).cast("string"))
    learned = F.when(F.col("__term").isNull(), at)
    rows = rows.withColumns({"promotes": F.coalesce(learned == F.col("seq"), F.lit(False)), "established": F.coalesce("__term", F.when(F.col("seq") > learned, F.col("__first_en")))})
    return rows.withColumn("conflict", F.col("established").isNotNull() & ~F.col("en").eqNullSafe(F.col("established"))).drop("__first_en", "__third", "__other", "__term")


def promotions(observed: DataFrame) -> DataFrame:
    """New terms."""
    return observed.filter("promotes").select("series", "source", "en", F.lit("confirmed").alias("status"), F.lit(False).alias("locked"), F.lit("learned").alias("source_type"))


def conflicts(observed: DataFrame) -> DataFrame:
    return observed.filter("conflict").select("series", "source", "established", F.col("en").alias("alternative"), "episode", "cue").distinct()


def local_hints(observed: DataFrame) -> DataFrame:
    """series, episode, source, en: an episode's last trusted rendering of a source that was not established."""
    rows = observed.filter("established is null and not coalesce(suspect, false) and en is not null")
    return latest_by(rows.select("series", "episode", "source", "en", "seq"), ["series", "episode", "source"]).drop("seq")


def dictionary(glossary: DataFrame, terms: DataFrame, candidates: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """series, source, en, authority: one rendering per source, that of the strongest authority.

    Glossary sources are normalised; of a source in both sections that in ``terms`` holds. Of several candidates the
    rarest rendering holds, ties by its text. Rows without a source or a rendering are ignored.
    """
    g = glossary.select("series", X.nfkc(F.col("source")).alias("source"), "en", F.lit("manual").alias("authority"), F.when(F.col("section") == "terms", 0).otherwise(1).cast("bigint").alias("tie"))
    ruled = terms.filter((F.col("status").isin("confirmed", "manual")) | F.coalesce("locked", F.lit(False)))
    t = ruled.select("series", "source", "en", F.when(F.coalesce("locked", F.lit(False)), "locked").otherwise("confirmed").alias("authority"), F.lit(0).cast("bigint").alias("tie"))
    every = g.unionByName(t)
    if hints is not None:
        every = every.unionByName(hints.select("series", "source", "en", F.lit("local").alias("authority"), F.lit(0).cast("bigint").alias("tie")))
    if candidates is not None:
        every = every.unionByName(candidates.select("series", "source", "en", F.lit("candidate").alias("authority"), F.col("n").cast("bigint").alias("tie")))
    rank = F.array_position(F.array(*[F.lit(a) for a in AUTHORITIES]), F.col("authority"))
    every = every.filter("source <> '' and en is not null").withColumn("rank", rank)
    w = Window.partitionBy("series", "source").orderBy("rank", "tie", "en")
    return every.withColumn("n", F.row_number().over(w)).filter("n = 1").select("series", "source", "en", "authority")


def _quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def patterns(entries: DataFrame) -> DataFrame:
    """series, pattern: a series' terms as one ordered alternation, longest first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("source")).alias("n"), F.col("source").alias("x"))))
    return entries.groupBy("series").agg(F.array_join(F.transform(ordered, lambda s: _quoted(s["x"])), "|").alias("pattern"))


def matched_terms(text: Column, pattern: Column) -> Column:
    """array<string>: the terms that a scan from left to right takes, the longest at each place, each once."""
    return F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(0)))


TRIE_CHARS = 8_000_000


def _trie(terms: Iterable[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = term
    return root


def _found(root: dict, text: str, every: bool) -> dict[tuple[int, str], None]:
    """(place, term): at each place the longest term that begins there, or every one."""
    out: dict[tuple[int, str], None] = {}
    for i in range(len(text)):
        node, j, best = root, i, None
        while j < len(text) and (node := node.get(text[j])) is not None:
            j += 1
            if "" in node:
                best = node[""]
                if every:
                    out[i, best] = None
        if best is not None and not every:
            out[i, best] = None
    return out


def _matcher(entries: dict[str | None, list[str]], every: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = {series: _trie(terms) for series, terms in entries.items()}
        for batch in batches:
            hits = [[{"at": at, "term": term} for at, term in _found(tries.get(series, {}), text or "", every)] for series, text in zip(batch["series"], batch["text"], strict=True)]
            yield pd.DataFrame({"series": batch["series"], "text": batch["text"], "hits": hits})

    return run


def _blocks(entries: DataFrame) -> Iterator[dict[str | None, list[str]]]:
    """The terms of all dictionaries in blocks of bounded size; a large dictionary is spread over several blocks."""
    block: dict[str | None, list[str]] = {}
    size = 0
    for row in entries.filter("source is not null and source <> ''").select("series", "source").toLocalIterator():
        if size > TRIE_CHARS:
            yield block
            block, size = {}, 0
        block.setdefault(row.series, []).append(row.source)
        size += len(row.source)
    if block:
        yield block


def trie_hits(texts: DataFrame, entries: DataFrame, every: bool = False) -> DataFrame:
    """series, text, hits (array of at and term) of distinct (series, text): per block of the dictionary, what begins where.

    The blocks stand in for a broadcast of bounded size: each is shipped to the tasks and meets all texts; a text may come
    out once per block. ``every``: all terms that a text holds, not only the longest at a place.
    """
    hits = None
    for block in _blocks(entries):
        part = texts.select("series", "text").mapInPandas(_matcher(block, every), "series string, text string, hits array<struct<at:int,term:string>>").filter("size(hits) > 0")
        hits = part if hits is None else hits.unionByName(part)
    return hits if hits is not None else texts.select("series", "text", F.array().cast("array<struct<at:int,term:string>>").alias("hits")).limit(0)


def contained(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """series, text, term: every dictionary term that stands in a distinct (series, text)."""
    return trie_hits(texts, entries, every=True).select("series", "text", F.explode("hits").alias("h")).select("series", "text", F.col("h.term").alias("term")).distinct()


def _longest(hits: DataFrame) -> DataFrame:
    """series, text, term: what a scan from left to right takes, the longest at each place, each once."""
    every = hits.groupBy("series", "text").agg(F.flatten(F.collect_list("hits")).alias("h"))  # at most one per place and block
    ordered = F.array_sort(F.transform("h", lambda x: F.struct(x["at"].alias("at"), (-F.length(x["term"])).alias("n"), x["term"].alias("term"))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("taken"))
    take = lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] - x["n"]).alias("end"), F.array_append(s["taken"], x["term"]).alias("taken"))).otherwise(s)
    return every.select("series", "text", F.explode(F.array_distinct(F.aggregate(ordered, start, take, lambda s: s["taken"]))).alias("term"))


def resolve(texts: DataFrame, entries: DataFrame, text: str = "text_zh") -> DataFrame:
    """series, text, term, en, authority: the dictionary terms in each distinct (series, text), matched longest first.

    The text is normalised for matching and returned as given. Each distinct text is resolved once. Series whose
    dictionary has up to PATTERN_TERMS entries are matched by one pattern, larger ones by tries over blocks of bounded size;
    both ways give the same (``dictionary_resolve`` and ``dictionary_trie`` are held against one SQL text).
    """
    distinct = texts.filter(F.col(text).isNotNull()).select("series", F.col(text).alias("text")).distinct()
    distinct = distinct.withColumn("plain", X.nfkc(F.col("text")))
    sizes = entries.groupBy("series").agg(F.count("*").alias("n"))
    small = entries.join(sizes.filter(F.col("n") <= PATTERN_TERMS).select("series"), "series", "left_semi")
    hits = distinct.join(patterns(small), "series").select("series", "text", F.explode(matched_terms(F.col("plain"), F.col("pattern"))).alias("term"))
    large = entries.join(sizes.filter(F.col("n") > PATTERN_TERMS).select("series"), "series", "left_semi")
    if not large.isEmpty():
        own = distinct.join(large.select("series").distinct(), "series", "left_semi")
        found = _longest(trie_hits(own.select("series", F.col("plain").alias("text")).distinct(), large)).withColumnRenamed("text", "plain")
        hits = hits.unionByName(own.join(found, ["series", "plain"]).select("series", "text", "term"))
    return hits.join(entries.withColumnRenamed("source", "term"), ["series", "term"]).select("series", "text", "term", "en", "authority")


def resolve_by_trie(texts: DataFrame, entries: DataFrame, text: str = "text_zh") -> DataFrame:
    """As ``resolve``, every series by tries."""
    distinct = texts.filter(F.col(text).isNotNull()).select("series", F.col(text).alias("text")).distinct().withColumn("plain", X.nfkc(F.col("text")))
    found = _longest(trie_hits(distinct.select("series", F.col("plain").alias("text")).distinct(), entries)).withColumnRenamed("text", "plain")
    return distinct.join(found, ["series", "plain"]).select("series", "text", "term").join(entries.withColumnRenamed("source", "term"), ["series", "term"]).select("series", "text", "term", "en", "authority")


def authority_counts(resolved: DataFrame, texts: DataFrame, text: str = "text_zh") -> DataFrame:
    """series and, per authority, the number of terms over all rows of ``texts`` (each row counts its distinct terms)."""
    weight = texts.filter(F.col(text).isNotNull()).groupBy("series", F.col(text).alias("text")).agg(F.count("*").alias("rows"))
    joined = resolved.join(weight, ["series", "text"])
    return joined.groupBy("series").agg(*[F.coalesce(F.sum(F.when(F.col("authority") == a, F.col("rows"))), F.lit(0)).alias(a) for a in AUTHORITIES])


def missing_terms(pairs: DataFrame, entries: DataFrame, ident: str, source: str = "source", en: str = "en", longest_match: bool = True) -> DataFrame:
    """ident, term, expected: hard terms of a source of which the English lacks the rendering.

    ``longest_match`` follows the dictionary scan; otherwise every term contained in the source is required.
    """
    hard = entries.filter(F.col("authority").isin(*HARD))
    rows = pairs.filter(F.col(source).isNotNull() & F.col(en).isNotNull()).select(ident, "series", F.col(source).alias("text"), F.col(en).alias("__en"))
    if longest_match:
        found = resolve(rows, entries, "text").filter(F.col("authority").isin(*HARD))
    else:
        found = contained(rows.select("series", "text").distinct(), hard).join(hard.withColumnRenamed("source", "term"), ["series", "term"])
    met = rows.join(found.select("series", "text", "term", F.col("en").alias("expected")), ["series", "text"])
    return met.filter(~F.col("__en").contains(F.col("expected"))).select(ident, "term", "expected")


def memory_keys(texts: DataFrame, entries: DataFrame, style: str, version: str, text: str = "text_zh") -> DataFrame:
    """series, text, signature: the key under which a text's translation is remembered. It changes with the style, the
    version and the hard terms that the text holds, and with nothing else."""
    distinct = texts.filter(F.col(text).isNotNull()).select("series", F.col(text).alias("text")).distinct()
    hard = resolve(texts, entries, text).filter(F.col("authority").isin(*HARD))
    mapped = hard.groupBy("series", "text").agg(F.array_sort(F.collect_set(F.concat_ws("=", "term", "en"))).alias("m"))
    key = X.signature(F.lit(style), F.lit(version), F.coalesce("m", F.array().cast("array<string>")))
    return distinct.join(mapped, ["series", "text"], "left").select("series", "text", key.alias("signature"))


def partition_hits(targets: DataFrame, memory: DataFrame, keys: Sequence[str] = ("series", "source", "signature")) -> DataFrame:
    """``targets`` with en of the memory's latest row of the same key, and hit. A null translation is no hit."""
    held = latest_by(memory, keys).filter("en is not null").select(*keys, F.col("en").alias("memory_en"))
    return targets.join(held, list(keys), "left").withColumn("hit", F.col("memory_en").isNotNull())


def hit_rate(partitioned: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    hits, n = F.count_if("hit"), F.count("*")
    return partitioned.groupBy(*keys).agg(hits.alias("hits"), (n - hits).alias("misses"), F.floor(hits * 100 / F.greatest(F.lit(1), n)).alias("percent"))


def entity_pairs(pairs: DataFrame, ident: str, source: str, en: str, suffixes: Sequence[str] = X.ENTITY_SUFFIXES) -> DataFrame:
    """ident, source_term, en_term: where both sides name exactly one entity, they are taken for the same."""
    rows = pairs.select(ident, X.entities_zh(F.col(source), suffixes).alias("z"), X.entities_en(F.col(en)).alias("e"))
    return rows.filter("size(z) = 1 and size(e) = 1").select(ident, F.get("z", F.lit(0)).alias("source_term"), F.get("e", F.lit(0)).alias("en_term"))


def store_stats(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def search(df: DataFrame, pattern: str, columns: Sequence[str] = ("source", "en")) -> DataFrame:
    """Rows in which a column contains the pattern, without regard to ASCII case; % and _ are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
    return df.filter(hit)


def set_term(terms: DataFrame, series: str, source: str, en: str, locked: bool = True) -> DataFrame:
    row = terms.sparkSession.createDataFrame([(series, source, en, "manual", locked, "manual")], "series string, source string, en string, status string, locked boolean, source_type string")
    return delete_term(terms, series, source).unionByName(row, allowMissingColumns=True)


def delete_term(terms: DataFrame, series: str, source: str) -> DataFrame:
    return terms.filter(~(F.col("series").eqNullSafe(series) & F.col("source").eqNullSafe(source)))


def lock_term(terms: DataFrame, series: str, source: str, locked: bool = True) -> DataFrame:
    """A term that doesn't exist stays so."""
    return terms.withColumn("locked", F.when((F.col("series") == series) & (F.col("source") == source), F.lit(locked)).otherwise(F.col("locked")))


def export(terms: DataFrame, candidates: DataFrame, found_conflicts: DataFrame, rows_per_part: int = 10_000) -> DataFrame:
    """series, kind, part, rows (JSON array text): what a series' store holds, in parts of bounded size."""

    def of(df: DataFrame, kind: str) -> DataFrame:
        item = F.struct(*[c for c in df.columns if c != "series"])
        part = F.pmod(F.xxhash64(*df.columns), F.greatest(F.lit(1), F.ceil(F.col("__n") / rows_per_part)))
        sized = df.join(df.groupBy("series").agg(F.count("*").alias("__n")), "series")
        return sized.groupBy("series", part.alias("part")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("rows")).select("series", F.lit(kind).alias("kind"), "part", "rows")

    return of(terms, "terms").unionByName(of(candidates, "candidates")).unionByName(of(found_conflicts, "conflicts"))


def versions(translations: DataFrame, current: str) -> DataFrame:
    """Translations with current: whether they belong to the current signature; earlier ones are kept as history."""
    return translations.withColumn("current", F.col("signature").eqNullSafe(current))


def compare_versions(translations: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """keys, a, b, same: two versions side by side; what one lacks is null."""
    of = lambda v, name: translations.filter(F.col("signature") == v).select(*keys, F.col("en").alias(name))
    return of(a, "a").join(of(b, "b"), list(keys), "full").withColumn("same", F.col("a").eqNullSafe(F.col("b")))


