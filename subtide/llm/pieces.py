"""Splitting of oversized texts at natural boundaries, with overlap, by pointer doubling (problem 6).

A text is cut into units (words; in texts without spaces, stretches of a few characters that end at marks). Every
boundary between units points to its farthest legal successor: the last boundary from which the piece that begins
with the overlap before this boundary still fits. Boundaries at sentence ends are preferred to those at clauses, and
these to plain words, as long as a piece of half the limit results. The pointer table is squared again and again, and
each squaring adds what the boundaries reached so far point to, so all greedy cuts of a text are there after
log2(boundaries) steps. The tables are arrays of the row, so the whole operator is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.columns import let

LIMIT, OVERLAP_CHARS = 84, 8
SPACE = r"[ \t\n\r\x{0B}\x{0C}\x{A0}\x{202F}]+"
#: What ends a sentence or a clause, with the quotes that may follow.
SENTENCE_END, CLAUSE_END = "[.!?…。！？][\"'”’)\\]]* ?$", "[,;:，；：、—–-][\"'”’)\\]]* ?$"


def normal(text: Column) -> Column:
    """Runs of spaces, tabs, newlines and no-break spaces count as one space, and not at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _units(text: Column, limit: int) -> Column:
    chunk = max(1, limit - OVERLAP_CHARS - 1)  # such a word still fits behind an overlap
    spaced = F.regexp_extract_all(text, F.lit(rf"[^ ]{{1,{chunk}}} ?"), F.lit(0))
    glued = F.regexp_extract_all(text, F.lit(r"[^\p{P}]{0,8}\p{P}{1,4}|[^\p{P}]{1,8}"), F.lit(0))
    return F.when(F.instr(text, " ") > 0, spaced).otherwise(glued)


def split(text: Column, limit: int = LIMIT) -> Column:
    """array<struct<no, start, end, text>> of a normalised text: pieces of at most ``limit`` code points.

    Each later piece starts with the last two words of the piece before it, or, where that has no two whole words or they
    leave no room for the next, with its last eight characters. start and end are offsets in the normalised text. A text
    within the limit is one piece, the empty text none; null gives null.
    """

    def nodes(units: Column, ends: Column) -> Column:
        """Per boundary: where a piece may begin before it (two words back if that leaves room, eight characters back), where
        one that ends at it stops showing, and how natural it is."""
        m = F.size(units)
        unit = lambda k: F.get(units, k - 1)  # noqa: E731  unit before node k
        end = lambda k: F.when(k <= 0, 0).otherwise(F.get(ends, k - 1))
        wordend = lambda k: (k <= 0) | F.coalesce(unit(k).endswith(" "), F.lit(False))
        shown = lambda k: end(k) - F.when((k > 0) & wordend(k), 1).otherwise(0)
        two = lambda k: F.when((k >= 2) & (k < m) & wordend(k) & wordend(k - 1) & wordend(k - 2) & (shown(k + 1) - end(k - 2) <= limit), end(k - 2))
        eight = lambda k: F.when((k == 0) | (k == m), end(k)).otherwise(F.greatest(F.lit(0), shown(k) - OVERLAP_CHARS))
        rank = lambda k: F.when(k == m, 9).when(unit(k).rlike(SENTENCE_END), 3).when(unit(k).rlike(CLAUSE_END), 2).when(wordend(k), 1).otherwise(0)
        return F.transform(F.sequence(F.lit(0), m), lambda k: F.struct(two(k).alias("two"), eight(k).alias("eight"), shown(k).alias("shown"), rank(k).alias("rank")))

    # A state is a boundary and how the piece from it begins: 2k + 1 two words back, 2k eight characters back.
    boundary = lambda state: F.shiftright(state, 1)
    begin = lambda node, state: let(F.get(node, boundary(state)), lambda n: F.when(state % 2 == 1, n["two"]).otherwise(n["eight"]))

    def successors(node: Column) -> Column:
        m = F.size(node) - 1

        def farthest(state: Column) -> Column:
            k = boundary(state)

            def from_start(start: Column) -> Column:
                def best(legal: Column) -> Column:
                    of = lambda rank, least: F.array_max(F.filter(legal, lambda q: (F.get(node, q)["rank"] >= rank) & (F.get(node, q)["shown"] - start >= least)))
                    return F.coalesce(of(9, 0), of(3, limit // 2), of(2, limit // 2), of(1, 0), F.array_max(legal), k + 1)

                reach = F.filter(F.sequence(k + 1, F.least(k + limit, m)), lambda q: F.get(node, q)["shown"] - start <= limit)
                # Two words may only be repeated where the piece holds both of them whole.
                return let(let(reach, best), lambda q: 2 * q + F.when(F.get(node, q)["two"] >= start, 1).otherwise(0))

            return F.when(k >= m, 2 * m).otherwise(let(begin(node, state), lambda start: F.when(start.isNull(), 2 * m).otherwise(from_start(start))))

        return F.transform(F.sequence(F.lit(0), 2 * m + 1), farthest)

    def cuts(succ: Column) -> Column:
        steps = F.ceil(F.log2(F.size(succ).cast("double"))).cast("int") + 1
        squared = F.aggregate(
            F.sequence(F.lit(1), steps),
            F.struct(succ.cast("array<int>").alias("t"), F.array(F.lit(0)).cast("array<int>").alias("r")),
            lambda a, _: F.struct(F.transform(a["t"], lambda j: F.get(a["t"], j)).cast("array<int>").alias("t"), F.array_distinct(F.concat(a["r"], F.transform(a["r"], lambda j: F.get(a["t"], j)))).cast("array<int>").alias("r")),
        )
        return F.array_sort(squared["r"])

    def pieces(body: Column, node: Column, at: Column) -> Column:
        def piece(i: Column) -> Column:
            a, z = begin(node, F.get(at, i)), F.get(node, boundary(F.get(at, i + 1)))["shown"]
            return F.struct((i + 1).alias("no"), a.alias("start"), z.alias("end"), F.trim(F.substring(body, a + 1, z - a)).alias("text"))

        return F.transform(F.sequence(F.lit(0), F.size(at) - 2), piece)

    def long(body: Column) -> Column:
        # Offsets are running sums of unit lengths, by doubling: after step k each place holds the sum of the last 2^k lengths.
        def with_units(units: Column) -> Column:
            steps = F.greatest(F.lit(1), F.ceil(F.log2(F.size(units).cast("double"))).cast("int"))
            back = F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
            add = lambda a, d: F.transform(a, lambda n, i: n + F.when(i >= d, F.get(a, i - d)).otherwise(0))
            ends = F.aggregate(back, F.transform(units, lambda u: F.length(u)), add)
            return let(ends, lambda e: let(nodes(units, e), lambda node: let(cuts(successors(node)), lambda at: pieces(body, node, at))))

        return let(_units(body, limit), with_units)

    whole = F.array(F.struct(F.lit(1).alias("no"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))
    return F.when(F.length(text) > limit, long(text)).when(F.length(text) > 0, whole).when(text.isNotNull(), F.slice(whole, 1, 0))


def split_rows(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, only_long: bool = True) -> DataFrame:
    """keys, n_pieces, no, start, end, piece: the pieces of every text, in order; rows whose text fits are left out
    unless ``only_long`` is False. Null texts give no rows; repeated rows are split each; other columns are not read."""
    rows = df.select(*keys, normal(F.col(text)).alias("body"))
    if only_long:
        rows = rows.filter(F.length("body") > limit)
    rows = rows.select(*keys, split(F.col("body"), limit).alias("p"))
    return rows.select(*keys, F.size("p").cast("bigint").alias("n_pieces"), F.inline("p")).select(
        *keys, "n_pieces", F.col("no").cast("bigint").alias("no"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("text").alias("piece")
    )
