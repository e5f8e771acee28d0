"""Time series: fills, gaps, segments, sliding windows, label masks, splits, orders and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import with_frames, with_last
from .ranks import numbered, with_running_totals


def ffill(df: DataFrame, keys: list[str], order: list, col: str, limit: int | None = 10, blocks: int | None = None) -> DataFrame:
    """E1 (``limit`` rows back), E1b and E1c (``limit=None``). Nulls take the last value before them within the keys."""
    if limit is None:
        return with_last(df, keys, order, col, blocks)
    return with_frames(df, keys, order, limit, lambda by: {col: F.last(col, ignorenulls=True).over(by.rowsBetween(-limit, 0))}, blocks)


#: Steps of a stretch of a grid
STRETCH = 10_000


def grid_of(spans: DataFrame, keys: list[str], ts: str, step: int) -> DataFrame:
    """Every step from _a to _z of each row: stretches first, so that no array is longer than one however long the span is."""
    stretches = spans.select(*keys, "_z", F.explode(F.sequence("_a", "_z", F.lit(step * STRETCH).cast("long"))).alias("_a"))
    return stretches.select(*keys, F.explode(F.sequence("_a", F.least("_z", F.col("_a") + step * (STRETCH - 1)), F.lit(step).cast("long"))).alias(ts))


def fill_gaps(df: DataFrame, keys: list[str], ts: str, step: int) -> DataFrame:
    """E2. Every step between the first and last time of each key; new rows have null values."""
    spans = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    return grid_of(spans, keys, ts, step).join(df, [*keys, ts], "left")


def segments(grid: DataFrame, ts: str = "bucket_ms", step: int = 30_000, factor: int = 3) -> DataFrame:
    """E3. (ts, segment from 0): a new segment where the step is longer than ``factor`` steps.

    The one window without partitions runs over distinct cells of time, whose number does not grow with the
    fleet or its traffic.
    """
    by_time = Window.orderBy(ts)
    gap = F.coalesce((F.col(ts) - F.lag(ts).over(by_time)) > factor * step, F.lit(False)).cast("long")
    return grid.select(ts).distinct().withColumn("_gap", gap).withColumn("segment", F.sum("_gap").over(by_time)).drop("_gap")


def windows(df: DataFrame, node: list[str], ts: str, values: list[str], w: int = 10, stride: int = 1, segment: str | None = "segment", blocks: int | None = None) -> DataFrame:
    """E4, E4b. One row for each run of ``w`` rows of a node (within a segment, if given), each ``stride`` rows.

    It has the last row's time, and ``steps``: an array of structs of the values, oldest first.
    """
    part = [*([segment] if segment else []), *node]
    if stride > 1:  # which rows end a window depends on their numbers in the whole series
        df = numbered(df, (ts,), "_place", 1 - w, tuple(part))
    frames = lambda by: {"_rows": F.row_number().over(by), "steps": F.collect_list(F.struct(*values)).over(by.rowsBetween(-(w - 1), 0))}
    rows = with_frames(df, part, [ts], w - 1, frames, blocks).where(F.col("_rows") >= w)
    if stride > 1:
        rows = rows.where(F.pmod(F.col("_place"), F.lit(stride)) == 0)
    return rows.select(*part, F.col(ts).alias("end_ts"), "steps")


def mask_labels(labels: DataFrame, node: str = "service", ts: str = "bucket_ms", y: str = "y", w: int = 10, percent: float = 0.5, mod: int = 10) -> DataFrame:
    """E5. Add ``y_seen``: the label, or 2 (unknown). From row ``w`` of each node on, labels of a class are counted,
    and those whose count mod ``mod`` is ``mod * percent`` or more are hidden.

    Rows are numbered, and late ones counted by class, in ranges of time that hand their totals on.
    """
    placed = numbered(labels, (ts,), "_rn", keys=(node,)).withColumn("_late", (F.col("_rn") >= w).cast("long"))
    counted = with_running_totals(placed, F.col(ts), ["_late"], (node, y))
    hidden = (F.col("_late") == 1) & (F.pmod(F.col("_late_before") + 1, F.lit(mod)) >= mod * percent)
    return counted.withColumn("y_seen", F.when(hidden, 2).otherwise(F.col(y))).drop("_late", "_late_before", "_rn")


def chrono_split(df: DataFrame, order: str, frac: float = 0.7, embargo: int = 0) -> DataFrame:
    """E6. Add ``part``: 'train' for the first ``frac`` of the rows, 'test' for the rest, null for an embargo between.

    Rows are counted per order value first and summed up by ranges of it; equal values stay together: rows up to
    the cut's value whose running count fits are train.
    """
    counts = df.groupBy(order).agg(F.count("*").alias("_c"))
    cut = F.floor(frac * F.col("_all"))
    before = F.col("_c_before") + F.col("_c")
    counted = with_running_totals(counts, F.col(order), ["_c"]).crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))  # one row
    placed = counted.select(order, F.when(before <= cut, "train").when(F.col("_c_before") >= cut + embargo, "test").when(F.lit(embargo) == 0, "test").alias("part"))
    return df.join(placed, order)


def summarize(windows_: DataFrame, value: str, mode: str = "last") -> DataFrame:
    """E7. Add ``summary`` of a value over a window's steps: the last step's, or the mean."""
    of = F.transform("steps", lambda s: s[value].cast("double"))
    mean = F.aggregate(of, F.lit(0.0), lambda a, v: a + v) / F.size("steps")
    return windows_.withColumn("summary", F.element_at(of, -1) if mode == "last" else mean)


def shift(df: DataFrame, keys: list[str], order: list, col: str, blocks: int | None = None) -> DataFrame:
    """E8. Values one row later within the keys, 0 at the start."""
    return with_frames(df, keys, order, 1, lambda by: {col: F.lag(col, 1, 0).over(by)}, blocks)


def ordered(df: DataFrame, cols: list[str | Column]) -> DataFrame:
    """F1. A global order, for a sink: ranges of the keys, sorted inside."""
    return df.orderBy(*cols)


def first_n(df: DataFrame, ts: str, n: int) -> DataFrame:
    """F2. Rows of the first ``n`` distinct times."""
    firsts = df.select(ts).distinct().orderBy(ts).limit(n)
    return df.join(F.broadcast(firsts) if n <= 100_000 else firsts, ts, "left_semi")


def top_types(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """F3. Values by falling count, then name."""
    counted = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)
    return counted.limit(n) if n else counted


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """S1. All rows, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common_features(df: DataFrame, entity: str = "service", feature: str = "feature") -> DataFrame:
    """S2. Features that every entity has."""
    n = df.select(F.count_distinct(entity).alias("_all"))
    each = df.groupBy(feature).agg(F.count_distinct(entity).alias("_n"))
    return each.crossJoin(F.broadcast(n)).where("_n = _all").select(feature)  # one row


def missing_steps(df: DataFrame, ts: str, step: int) -> DataFrame:
    """S3. Steps between the first and last time at which there is no row."""
    span = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_z")).where("_a is not null")
    return grid_of(span, [], ts, step).join(df.select(ts).distinct(), ts, "left_anti")
