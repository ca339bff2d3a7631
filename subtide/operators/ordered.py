"""Neighbours, positions and run labels in an ordered sequence, without one task per entity.

A sequence is cut into blocks of its leading order column. Windows run inside (entity, block); what passes from block to
block is one row per block: its first and last row, its number of rows, its last boundary. An entity that holds any
share of the rows is thus spread over many tasks, and the window over its blocks sees one row for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096
_INNER = ("__k", "__b")


def _windows(order: Sequence[str]):
    return Window.partitionBy(*_INNER).orderBy(*order), Window.partitionBy("__k").orderBy("__b")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``df`` with before and after (structs of ``carry`` from the rows next to each, null at the ends) and position.

    ``order``: columns that order the rows of an entity, the first a number, which also sets the blocks; null orders
    come first, in blocks of the next column if that is a number. Null keys are an entity of their own. Keeps two inner columns
    for ``labels``; ``plain`` drops them.
    """
    numeric = len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType)
    unset = F.coalesce(F.floor(F.col(order[1]) / block), F.lit(-(2**51))) if numeric else F.lit(0)
    keyed = df.withColumns({"__k": F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"}), "__b": F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(2**53)) + unset)})
    inside, blocks = _windows(order)
    item = F.struct(*[F.col(f"`{c}`") for c in carry])
    here = keyed.withColumns({"__n": F.row_number().over(inside), "__before": F.lag(item).over(inside), "__after": F.lead(item).over(inside), "__head": F.first(item).over(inside), "__last": F.lead(F.lit(1)).over(inside).isNull()})
    edges = here.filter("__last").select(*_INNER, F.col("__n").alias("__size"), item.alias("__tail"), "__head")
    passed = edges.select(
        *_INNER, F.lag("__tail").over(blocks).alias("__tail"), F.lead("__head").over(blocks).alias("__next"),
        F.coalesce(F.sum("__size").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
    )
    joined = here.drop("__head", "__last").join(passed, list(_INNER))
    return joined.withColumns({"before": F.coalesce("__before", "__tail"), "after": F.coalesce("__after", "__next"), "position": F.col("__n") + F.col("__offset")}).drop("__before", "__after", "__tail", "__next", "__offset", "__n")


def labels(df: DataFrame, order: Sequence[str], boundary: Column, name: str = "label") -> DataFrame:
    """The result of ``neighbours`` with, per row, the position of the last row at or before it where ``boundary`` holds."""
    inside, blocks = _windows(order)
    marked = df.withColumn("__at", F.when(F.coalesce(boundary, F.lit(False)), F.col("position")))
    local = marked.withColumns({"__local": F.max("__at").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__last": F.lead(F.lit(1)).over(inside).isNull()})
    opened = local.filter("__last").select(*_INNER, F.max("__local").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("__open"))
    return local.join(opened, list(_INNER)).withColumn(name, F.coalesce("__local", "__open")).drop("__at", "__local", "__open", "__last")


def plain(df: DataFrame) -> DataFrame:
    return df.drop(*_INNER)
