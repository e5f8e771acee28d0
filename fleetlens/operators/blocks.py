"""Frames and states over series of any length: each series is cut into ranges of its order, and no task holds a whole one.

Rows of all series are dealt to common ranges of their order, so a block is what a series has in a range. A frame of a few rows back needs
the last rows ahead of a block: the first and last rows of all blocks, few in number, are joined up once more. A state without an end (the
last value, a count) is summed up for each block, handed down the blocks of its series and added to what the block itself says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .ranks import in_ranges


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_blocks(df: DataFrame, order: list, blocks: int | None = None) -> DataFrame:
    """Add ``_b``: the number of the range of ``order`` that a row is in."""
    return in_ranges(df, F.struct(*(_col(c).alias(f"_o{i}") for i, c in enumerate(order))), blocks, "_b")


def with_frames(df: DataFrame, keys: list[str], order: list, back: int, columns: Callable[[WindowSpec], dict[str, Column]], blocks: int | None = None) -> DataFrame:
    """Add ``columns`` of the window of each key's rows in ``order``, which may look at ``back`` rows before a row at most.

    A row further than that into its block has all it needs there. The first and last ``back`` rows of the blocks of a series stand next to each
    other as they do in the whole series, so a second window over them alone decides the first rows. A row that has fewer
    than ``back`` rows before it in its series has as many in that window.
    """
    inside, joined = Window.partitionBy(*keys, "_b").orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    dealt = in_blocks(df, order, blocks)
    dealt = dealt.withColumns({"_n": F.row_number().over(inside), "_tail": F.lead(F.lit(1), back).over(inside).isNull()})
    whole = dealt.withColumns(columns(inside)).where(F.col("_n") > back)
    edges = dealt.where((F.col("_n") <= back) | F.col("_tail")).withColumns(columns(joined)).where(F.col("_n") <= back)
    return whole.unionByName(edges).drop("_b", "_n", "_tail")


def with_last(df: DataFrame, keys: list[str], order: list, col: str, blocks: int | None = None) -> DataFrame:
    """``col`` with nulls replaced by the last value before them in the series, however far back."""
    dealt = in_blocks(df, order, blocks)
    place = F.struct(*(_col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    states = dealt.groupBy(*keys, "_b").agg(F.max_by(col, F.when(F.col(col).isNotNull(), place)).alias("_last"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    handed = states.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), F.last("_last", ignorenulls=True).over(ahead).alias("_carry"))
    own = F.last(col, ignorenulls=True).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    filled = dealt.withColumn("_own", own).join(handed, same, "left")
    return filled.withColumn(col, F.coalesce("_own", "_carry")).drop("_own", "_carry", "_b", "_kb", *(f"_k{i}" for i in range(len(keys))))
