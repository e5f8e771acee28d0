"""Fitted state as tables: what a scale, a mean, a median or a dictionary was fitted to, saved by one run and applied by a later one.

Each state is a small table by key that says everything about the rows it was fitted on. States of two parts add up to that of both, so a
fit over days is the sum of the days' fits, and new days never need the old rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, quantiles


def fit_ranges(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """D12, D12c. (keys, low, high): the range of each series."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def fit_totals(df: DataFrame, keys: list[str], cells: int, value: str = "value") -> DataFrame:
    """D13. (keys, total, cells): the sum of each series over a grid of ``cells``."""
    return df.groupBy(*keys).agg(F.sum(value).cast("double").alias("total"), F.lit(cells).cast("long").alias("cells"))


def fit_counts(df: DataFrame, value: str) -> DataFrame:
    """H3. (value, n): how often each value occurs, from which medians follow exactly."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def added(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The state of two parts: lows and highs by the extreme, all else by the sum; ``keys`` is ['value'] for counts.

    A series that only one part has keeps its own total, over the cells of both.
    """
    rules = {"low": F.min("low"), "high": F.max("high"), "total": F.sum("total"), "n": F.sum("n")}
    both = a.unionByName(b)
    merged = both.groupBy(*keys).agg(*(f.alias(c) for c, f in rules.items() if c in a.columns), *([F.first("cells").alias("_own")] if "cells" in a.columns else []))
    if "cells" not in a.columns:
        return merged.select(*a.columns)
    cells = a.agg(F.max("cells").alias("x")).unionByName(b.agg(F.max("cells").alias("x"))).agg(F.sum("x").alias("cells"))
    return merged.drop("_own").crossJoin(F.broadcast(cells)).select(*a.columns)  # one row


def scaled_to(df: DataFrame, state: DataFrame, keys: list[str], value: str = "value", flat_to_zero: bool = False) -> DataFrame:
    """D12, D12b with saved ranges: ``min_max`` of rows that were not fitted on. A series without a state has null values."""
    width = F.col("high") - F.col("low")
    moved = F.col(value) - F.col("low")
    out = F.coalesce(F.try_divide(moved, width), F.lit(0.0)) if flat_to_zero else moved / F.when(width == 0, 1.0).otherwise(width)
    return df.join(state, keys, "left").withColumn(value, out).drop("low", "high")


def counts_scaled_to(df: DataFrame, state: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """D12c with saved ranges. Add ``scaled``."""
    return df.join(state, keys, "left").withColumn("scaled", (F.col(value) - F.col("low")) / (F.col("high") - F.col("low") + 1e-6)).drop("low", "high")


def divided_by(df: DataFrame, state: DataFrame, keys: list[str], value: str = "duration_sum", factor: float = 10) -> DataFrame:
    """D13 with saved totals. Add ``scaled``."""
    return df.join(state, keys, "left").withColumn("scaled", F.col(value) / (factor * F.col("total") / F.col("cells") + 1e-6)).drop("total", "cells")


def constants_of(counts: DataFrame) -> DataFrame:
    """H3. One row (median, mad) of counted values: the lower median, and that of the distances to it."""
    middle = quantiles(counts, "value", [0.5], discrete=True).select(F.col("q")[0].alias("median"))
    far = counts.crossJoin(F.broadcast(middle)).groupBy(F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("n").alias("n"))  # one row
    return quantiles(far, "value", [0.5], discrete=True).select(F.col("q")[0].alias("mad")).crossJoin(F.broadcast(middle)).select("median", "mad")


def prob_by(df: DataFrame, col: str, constants: DataFrame) -> DataFrame:
    """H3 with saved constants. Add ``prob``."""
    z: Column = (F.col(col) - F.col("median")) / (1.4826 * F.greatest(F.col("mad"), F.lit(1e-6)))
    return df.crossJoin(F.broadcast(constants)).withColumn("prob", 1 / (1 + F.exp(-z))).drop("median", "mad")  # one row


def extended(saved: DataFrame, df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """C9. A saved dictionary and, numbered after it in order, values of ``df`` that it lacks; saved codes never change."""
    fresh = df.select(col).where(F.col(col).isNotNull()).distinct().join(saved, col, "left_anti")
    start = saved.agg(F.coalesce(F.max(code) + 1, F.lit(0))).first()[0]
    return saved.select(col, code).unionByName(numbered(fresh, (col,), code, start).select(col, code))
