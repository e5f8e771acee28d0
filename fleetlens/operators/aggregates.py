"""Aggregates: log counts, edges, duplicate samples, metric quality, scaling, labels and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LEVELS, bucket, finite, reduce_mode
from ..storage import stored
from .ranks import quantiles


def template_counts(lines: DataFrame, step: int = 30_000, template: str = "template_id") -> DataFrame:
    """D1, long: (bucket_ms, service, template, n)."""
    return lines.groupBy(bucket(F.col("ts_ms"), step).alias("bucket_ms"), "service", template).agg(F.count("*").alias("n"))


def pivot_templates(counts: DataFrame, ids: list, template: str = "template_id") -> DataFrame:
    """D1, wide, for a sink: one column template_<id> for each listed id, absent ones 0."""
    wide = counts.groupBy("bucket_ms", "service").pivot(template, ids).agg(F.sum("n"))
    return wide.select("bucket_ms", "service", *(F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"template_{i}") for i in ids))


def level_counts(lines: DataFrame, step: int = 30_000, levels: tuple[str, ...] = (*LEVELS, "UNKNOWN")) -> DataFrame:
    """D2, D3. (bucket_ms, service, level_<l>..., log_total): one pass, absent levels 0."""
    return lines.groupBy(bucket(F.col("ts_ms"), step).alias("bucket_ms"), "service").agg(*(F.count_if(F.col("level") == v).alias(f"level_{v.lower()}") for v in levels), F.count("*").alias("log_total"))


def edge_stats(edges: DataFrame, keys: tuple[str, ...] = ("bucket_ms", "src", "dst", "status_code")) -> DataFrame:
    """D4. Duration sum and mean and count of each edge."""
    return edges.groupBy(*keys).agg(F.sum("duration_s").alias("duration_sum"), F.avg("duration_s").alias("duration_mean"), F.count("*").alias("n"))


def self_loops(spans: DataFrame, step: int = 30_000) -> DataFrame:
    """D4b. Durations per (bucket, service, status) on the diagonal: src = dst."""
    rows = spans.select(bucket(F.col("start_ms"), step).alias("bucket_ms"), F.col("service_name").alias("src"), F.col("service_name").alias("dst"), "status_code", ((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)).alias("duration_s"))
    return edge_stats(rows)


def drop_equal_samples(points: DataFrame, keys: tuple[str, ...] = ("service", "feature", "ts_ms", "value")) -> DataFrame:
    """D5. One row of those with equal keys."""
    return points.select(*keys).distinct()


def reduce_duplicates(points: DataFrame, keys: tuple[str, ...] = ("ts_ms", "service", "feature")) -> DataFrame:
    """D6. One finite value per key. A single value that is not 0 among several wins; else those that are not 0
    (all, if none is) are reduced as the feature's name says. Keys without a finite value have none."""
    value = finite(F.col("value"))
    live = F.abs(F.col("_v")) > 1e-12
    got = points.withColumn("_v", value).groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.count_if(live).alias("_live"), *(f(F.when(live, F.col("_v"))).alias(f"_{n}") for n, f in (("sum", F.sum), ("max", F.max), ("mean", F.avg))), *(f("_v").alias(f"_all_{n}") for n, f in (("sum", F.sum), ("max", F.max), ("mean", F.avg)))
    )
    mode = reduce_mode(F.col("feature"))
    pick = lambda p: F.when(mode == "sum", F.col(f"{p}sum")).when(mode == "max", F.col(f"{p}max")).otherwise(F.col(f"{p}mean"))
    out = F.when(F.col("_n") == 0, None).when((F.col("_live") == 1) & (F.col("_n") > 1), F.col("_max")).when(F.col("_live") > 0, pick("_")).otherwise(pick("_all_"))
    return got.select(*keys, out.alias("value"))


def mean_by(df: DataFrame, keys: list, value: str = "value") -> DataFrame:
    """D7, D8. The mean per key, nulls skipped."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def metric_quality(points: DataFrame, n_grid: int, step: int = 30_000, exact: bool = True, keys: tuple[str, ...] = ("service", "feature")) -> DataFrame:
    """D9. Coverage, distinct values, share not 0, q95 - q05, its ratio to the mean and the score of each series.

    The points are read twice: values are counted per series once and kept, and all but the cells follows from the counts; exact
    quantiles come from running totals of them, so no task holds a series. ``exact=False`` estimates the quantiles in one pass.
    """
    keyed = points.withColumn("_v", finite(F.col("value"))).withColumn("_k", F.struct(*keys))
    some, counts = keyed.where(F.col("_v").isNotNull()), stored(keyed.groupBy("_k", "_v").agg(F.count("*").alias("n")), "values")
    known = counts.where(F.col("_v").isNotNull())
    cells = some.select("_k", bucket(F.col("ts_ms"), step)).distinct().groupBy("_k").agg(F.count("*").alias("_cells"))
    total = lambda v: F.sum(v * F.col("n")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("n")))
    got = counts.groupBy("_k").agg(F.count("_v").alias("unique_count"), total((F.abs("_v") > 1e-12).cast("double")).alias("non_zero_ratio"), total(F.abs("_v")).alias("_mean"))
    spread = quantiles(known, "_v", [0.05, 0.95], ("_k",)).withColumnRenamed("q", "_q") if exact else some.groupBy("_k").agg(F.percentile_approx("_v", [0.05, 0.95], 10_000).alias("_q"))
    got = got.join(cells, "_k", "left").join(spread, "_k", "left").select("*", *(F.col("_k").getField(k).alias(k) for k in keys))
    span = F.coalesce(F.col("_q")[1] - F.col("_q")[0], F.lit(0.0))
    out = got.select(*keys, F.coalesce(F.col("_cells") / F.lit(float(max(n_grid, 1))), F.lit(0.0)).alias("coverage"), "unique_count", F.coalesce("non_zero_ratio", F.lit(0.0)).alias("non_zero_ratio"), span.alias("dynamic_span"), F.coalesce(span / (F.col("_mean") + 1e-6), F.lit(0.0)).alias("dynamic_ratio"))
    score = F.col("coverage") * (0.5 + 0.5 * F.col("non_zero_ratio")) * (F.log1p("dynamic_span") + 0.1 * F.log1p("unique_count"))
    return out.withColumn("score", F.when(F.lit(n_grid > 0), score).otherwise(0.0))


def quality_reason(q: DataFrame, coverage: float = 0.2, distinct: int = 2, span: float = 1e-10, ratio: float = 1e-4) -> DataFrame:
    """D10. Add the first reason to leave a series out, null if there is none."""
    flat = (F.col("dynamic_span") < span) | (F.col("dynamic_ratio") < ratio)
    return q.withColumn("reason", F.when(F.col("coverage") < coverage, "low_coverage").when(F.col("unique_count") < distinct, "constant").when(flat, "low_dynamic"))


def quality_filter(q: DataFrame, entity: str = "service", **limits) -> DataFrame:
    """D10. The series to keep; all of them, if any entity would lose everything."""
    judged = quality_reason(q, **limits)
    lost = judged.groupBy(entity).agg(F.count_if(F.col("reason").isNull()).alias("_kept")).agg(F.bool_or(F.col("_kept") == 0).alias("_fall_back"))
    return judged.crossJoin(F.broadcast(lost)).where(F.col("reason").isNull() | F.col("_fall_back")).drop("reason", "_fall_back")  # one row


def drop_flat(points: DataFrame, least: float = 1e-10) -> DataFrame:
    """D11. Points of features whose sample variance reaches ``least`` in some entity; one of unknown variance counts as alive."""
    each = points.groupBy("service", "feature").agg(F.var_samp("value").alias("_var"))
    flat = each.groupBy("feature").agg(F.bool_and(F.coalesce(F.col("_var") < least, F.lit(False))).alias("_flat")).where("_flat").select("feature")
    return points.join(flat, "feature", "left_anti")


def _fitted(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.where(fit_on)


def min_max(points: DataFrame, keys: list[str], value: str = "value", flat_to_zero: bool = False, fit_on: Column | None = None) -> DataFrame:
    """D12 (a flat series divides by 1), D12b (a flat or missing value becomes 0): values scaled to [0, 1] per series.

    With ``fit_on`` the bounds are those of the rows where it holds, the train part for example; a series without any has null values.
    """
    bounds = _fitted(points, fit_on).groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.col("_high") - F.col("_low")
    joined = points.join(bounds, keys, "inner" if fit_on is None else "left")
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_low"), width), F.lit(0.0)) if flat_to_zero else (F.col(value) - F.col("_low")) / F.when(width == 0, 1.0).otherwise(width)
    return joined.withColumn(value, scaled).drop("_low", "_high")


def scale_counts(counts: DataFrame, keys: list[str], value: str = "n", mode: str = "rows", n_grid: int | None = None, fit_on: Column | None = None) -> DataFrame:
    """D12c. Log counts scaled by their feature's range + 1e-6; the minimum over rows, or (``mode='buckets'``) over the
    buckets' maxima and with 1 as the largest result.

    With buckets, ``n_grid`` is the number of cells of the grid. The minimum is then 1 for a feature that every cell
    has and 0 for others, and 0 for all if there are logs in fewer cells than that.
    ``fit_on`` as for ``min_max``.
    """
    seen = _fitted(counts, fit_on)
    if mode == "rows":
        bounds = seen.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    else:
        tops = seen.groupBy(*keys, "bucket_ms").agg(F.max(value).alias("_top"))
        bounds = tops.groupBy(*keys).agg(F.min("_top").alias("_low"), F.max("_top").alias("_high"), F.count("*").alias("_in"))
        if n_grid is not None:  # a feature that a bucket with logs lacks has a maximum of 0 there
            cells = counts.select("bucket_ms").distinct().agg(F.count("*").alias("_all"))
            bounds = bounds.crossJoin(F.broadcast(cells)).withColumn("_low", F.when((F.col("_all") == n_grid) & (F.col("_in") == F.col("_all")), F.least("_low", F.lit(1))).otherwise(0)).drop("_all")  # one row
        bounds = bounds.drop("_in")
    scaled = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-6)
    return counts.join(bounds, keys, "inner" if fit_on is None else "left").withColumn("scaled", scaled if mode == "rows" else F.least(scaled, F.lit(1.0))).drop("_low", "_high")


def scale_by_mean(stats: DataFrame, n_grid: int, keys: tuple[str, ...] = ("src", "dst", "status_code"), value: str = "duration_sum", factor: float = 10, fit_on: Column | None = None) -> DataFrame:
    """D13. Values by ``factor`` times their mean over the whole grid (absent cells count as 0) + 1e-6.

    ``fit_on`` as for ``min_max``; ``n_grid`` is then the number of cells of that part.
    """
    means = _fitted(stats, fit_on).groupBy(*keys).agg((F.sum(value) / n_grid).alias("_mean"))
    return stats.join(means, list(keys), "inner" if fit_on is None else "left").withColumn("scaled", F.col(value) / (factor * F.col("_mean") + 1e-6)).drop("_mean")


def service_graph(edges: DataFrame) -> DataFrame:
    """D14. (src, dst): the distinct pairs of services in both directions."""
    pairs = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def incidence(graph: DataFrame) -> DataFrame:
    """D15. (node, src, dst, share): each edge at either end, a node's shares summing to 1; self loops count once."""
    ends = graph.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "src", "dst")
    degree = ends.groupBy("node").agg(F.count("*").alias("_d"))
    return ends.join(degree, "node").select("node", "src", "dst", (1 / F.col("_d")).alias("share"))


def type_distribution(events: DataFrame) -> DataFrame:
    """D16, F3. Events per type, the most frequent first, then by name."""
    return events.groupBy("anomaly_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anomaly_type")


def label_coverage(cells: DataFrame, types: str = "types") -> DataFrame:
    """D17. Cells whose list of types holds each type."""
    return cells.select(F.explode(F.array_distinct(types)).alias("anomaly_type")).groupBy("anomaly_type").agg(F.count("*").alias("cells"))


def anomaly_rate(labels: DataFrame) -> DataFrame:
    """D17. The share of anomalous cells of each service."""
    return labels.groupBy("service").agg(F.avg("y").alias("rate"), F.sum("y").alias("anomalies"))


def telemetry_profile(df: DataFrame, ts: str = "ts_ms", step: int = 30_000) -> DataFrame:
    """D18. First and last cell, cells, days and rows per cell."""
    cell = bucket(F.col(ts), step)
    return df.agg(F.min(cell).alias("first_ms"), F.max(cell).alias("last_ms"), F.count_distinct(cell).alias("cells"), F.count_distinct(bucket(F.col(ts), 86_400_000)).alias("days"), F.try_divide(F.count("*"), F.count_distinct(cell)).alias("rows_per_cell"))


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    """D19. Distinct values, in order."""
    return df.select(col).distinct().orderBy(col)


def labels_by_cell(cells: DataFrame) -> DataFrame:
    """D20. (bucket_ms, service, y, types): the distinct types of each marked cell, first seen first.

    Each type is reduced to its first event before the list is collected, so a list is as long as there are types.
    """
    first = cells.groupBy("bucket_ms", "service", "anomaly_type").agg(F.min("idx").alias("_first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_first", "anomaly_type"))), lambda x: x["anomaly_type"])
    return first.groupBy("bucket_ms", "service").agg(F.lit(1).alias("y"), ordered.alias("types"))


def types_text(types: Column | str = "types") -> Column:
    """D20. The list of types as text with | between."""
    return F.array_join(types, "|")


def window_counters(windows: DataFrame, visible: str = "visible", real: str = "real", traces: str = "traces") -> DataFrame:
    """D21. How many windows show a visible anomaly, a real one, and any trace."""
    some = lambda c, name: F.count_if(F.col(c) > 0).alias(name)
    return windows.agg(F.count("*").alias("windows"), some(visible, "visible"), some(real, "real"), some(traces, "traced"))


def unmatched_report(events: DataFrame, n: int = 10, chars: int = 150) -> DataFrame:
    """D22. At most ``n`` distinct level|message heads of events of unknown type, in order."""
    odd = events.where(F.col("anomaly_type").isin("[unknown]", "[unknown_warning]"))
    return odd.select(F.concat_ws("|", "level", F.left("message", F.lit(chars))).alias("line")).distinct().orderBy("line").limit(n)
