"""Order in data of any size: ranges of rows, running totals, exact quantiles, without a task that sees all rows of a group."""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Ranges that rows are dealt to at most, and rows of the sample for each of them
MOST_RANGES, SAMPLE = 1000, 40


def range_count(df: DataFrame, ranges: int | None = None) -> int:
    return max(2, ranges or min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def bounds_of(df: DataFrame, at: Column, ranges: int) -> list:
    """Values of ``at`` that cut the rows into about even ranges: of a sample, those whose hashes are the smallest. A job that runs at once."""
    sample = df.select(F.struct(at.alias("v")).alias("s")).orderBy(F.xxhash64("s")).limit(SAMPLE * ranges)
    whole = sample.agg(F.array_sort(F.collect_list("s")).alias("a"))
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("a", F.floor(i * F.size("a") / ranges).cast("int"))))
    return [one for one in whole.select(cut).first()[0] if one is not None]  # fewer than ranges


def literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)))
    return F.lit(value).cast(kind)


def in_ranges(df: DataFrame, at: Column, ranges: int | None = None, name: str = "_r") -> DataFrame:
    """Add the number of the range that each row is in, in the order of ``at`` (of any type that has one, texts and structs too).

    The ranges' bounds are read from a sample first, as for any partitioning by ranges, and stand in the plan as a tree of
    comparisons. Which range a row is in depends on ``at`` alone, so it is the same whenever and wherever it is computed.
    """
    wrapped = df.withColumn("_at", F.struct(at.alias("v")))
    kind, bounds = wrapped.schema["_at"].dataType, bounds_of(df, at, range_count(df, ranges))

    def place(lo: int, hi: int) -> Column:
        """How many of the bounds are below, if those before ``lo`` are and those from ``hi`` on are not."""
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col("_at") > literal(bounds[middle], kind), place(middle + 1, hi)).otherwise(place(lo, middle))

    return wrapped.withColumn(name, place(0, len(bounds))).drop("_at")


def with_running_totals(df: DataFrame, place: Column, values: list[str], keys: tuple[str, ...] = (), order: tuple = (), ranges: int | None = None, dealt: tuple | None = None) -> DataFrame:
    """Add ``<value>_before``: within ``keys``, sums over all rows ahead in the order of ``place`` and ``order``.

    Rows are dealt to ranges of (keys, place, order); each range sums its own and adds the totals of its key's ranges
    ahead, of which there are as many as ranges. Only rows that tie in all of it cannot be dealt out. The rows are read for the bounds, the
    totals and the sums, so they are written once and what they are made of is computed once. ``dealt``: values in the same order that the
    rows are dealt by instead, if those of the order are long.
    """
    df = stored(df, "ranked")
    of = F.struct(*keys) if keys else F.lit(0)
    ways = [F.struct(*(c if isinstance(c, Column) else F.col(c) for c in (*keys, *(dealt or (place, *order)))))]
    dealt = in_ranges(df.withColumns({"_rk": of, "_pl": place}), *ways, ranges=ranges)
    totals = dealt.groupBy("_rk", "_r").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    ahead = Window.partitionBy("_rk").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_rk", "_r", *(F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("_rk", "_r").orderBy("_pl", *order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{v}_before") for v in values)).join(shifts, ["_rk", "_r"])
    return summed.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).drop("_rk", "_pl", "_r", *(f"_{v}" for v in values))


def numbered(df: DataFrame, order: tuple, name: str, start: int = 0, keys: tuple[str, ...] = (), dealt: tuple | None = None) -> DataFrame:
    """Add the number of each row in ``order`` (within ``keys``), from ``start``; ``dealt`` as in ``with_running_totals``."""
    first, *rest = (F.col(c) if isinstance(c, str) else c for c in order)
    counted = with_running_totals(df.withColumn("_one", F.lit(1).cast("long")), first, ["_one"], keys, tuple(rest), dealt=dealt)
    return counted.withColumn(name, (F.col("_one_before") + start).cast("long")).drop("_one", "_one_before")


def counts_of(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, n): how often each value that is not null occurs."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, value: str, fractions: list[float], keys: tuple[str, ...] = (), discrete: bool = False) -> DataFrame:
    """(keys, q): the exact quantiles of counted values, in the order of ``fractions``.

    Continuous ones lie between their neighbours in proportion, a discrete one is the smallest value that the
    fraction of all values does not exceed. Without keys there is one row, null for no values.
    """
    ranked = with_running_totals(counts, F.col(value), ["n"], keys).withColumn("_rk", F.struct(*keys) if keys else F.lit(0))
    totals = counts.groupBy((F.struct(*keys) if keys else F.lit(0)).alias("_rk")).agg(F.sum("n").alias("_total"))
    ranked = ranked.join(totals, "_rk") if keys else ranked.crossJoin(F.broadcast(totals.drop("_rk")))  # one row
    holds = lambda rank: F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col(value)))
    picked = []
    for fraction in fractions:
        if discrete:
            picked.append(holds(F.greatest(F.ceil(fraction * F.col("_total")), F.lit(1)) - 1))
            continue
        at = (F.col("_total") - 1) * fraction
        low, high = holds(F.floor(at)), holds(F.ceil(at))
        picked.append(low + (high - low) * F.max(at - F.floor(at)))
    return ranked.groupBy(*keys).agg(F.array(*picked).alias("q"))


#: Values that are brought together to take exact quantiles from, and the sketch's accuracy
MOST_VALUES, ACCURACY = 100_000, 10_000


def exact_quantiles(df: DataFrame, value: Column, fractions: list[float]) -> list:
    """The exact discrete quantiles of all values that are not null: the smallest value that the fraction of them does not exceed.

    A mergeable sketch gives two values between which a quantile must lie; one pass counts what is below and what is in between, and
    the distinct values in between are brought together with their counts. If they are too many, the sketch is taken again
    of what is in between, some thousandth of what it was. Two to three reads of most data, whatever its size; it
    runs when it is called. Nulls only give nulls.
    """
    values = df.select(value.alias("v")).where("v is not null")
    near = lambda f: [min(1.0, max(0.0, f + d)) for d in (-2 / ACCURACY, 2 / ACCURACY)]
    sketch = lambda part, shares: part.agg(F.percentile_approx("v", [x for f in shares for x in near(f)], ACCURACY).alias("q"), F.count("*").alias("n")).first()
    inside = lambda b: (F.lit(True) if b[0] is None else F.col("v") >= F.lit(b[0])) & (F.lit(True) if b[1] is None else F.col("v") <= F.lit(b[1]))
    first = sketch(values, fractions)
    if not first["n"]:
        return [None] * len(fractions)
    ranks = [max(1, math.ceil(f * first["n"])) for f in fractions]
    brackets = [tuple(first["q"][2 * i : 2 * i + 2]) for i in range(len(fractions))] if first["n"] > MOST_VALUES else [(None, None)] * len(fractions)
    below, seen = [0] * len(fractions), set()
    while first["n"] > MOST_VALUES:
        counted = values.agg(*(F.count_if(F.col("v") < F.lit(b[0])) if b[0] is not None else F.lit(0) for b in brackets), *(F.count_if(inside(b)) for b in brackets)).first()
        below, within = counted[: len(brackets)], counted[len(brackets) :]
        wide = [i for i in range(len(brackets)) if not below[i] < ranks[i] <= below[i] + within[i]]
        full = [i for i, b in enumerate(brackets) if i not in wide and within[i] > MOST_VALUES and b[0] != b[1] and (i, b) not in seen]
        seen |= set(enumerate(brackets))  # one that does not get narrower has nearly all its rows at its ends
        if not wide and not full:
            break
        for i in wide:  # the sketch missed: look on that side
            brackets[i] = (None, brackets[i][0]) if ranks[i] <= below[i] else (brackets[i][1], None)
        for i in full:
            brackets[i] = tuple(sketch(values.where(inside(brackets[i])), [(ranks[i] - below[i]) / within[i]])["q"])
    listed = {b: values.where(inside(b)).groupBy("v").count().orderBy("v").collect() for b in set(brackets) if b[0] is None or b[0] != b[1]}
    out = []
    for rank, under, bracket in zip(ranks, below, brackets):
        if bracket not in listed:
            out.append(bracket[0])
            continue
        ends = list(accumulate(n for _, n in listed[bracket]))
        out.append(listed[bracket][bisect_left(ends, rank - under)][0])
    return out
