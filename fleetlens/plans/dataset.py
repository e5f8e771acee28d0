"""Aligned tables to the windowed training set: the service profile, and the host profile from raw files on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, joins, records, series
from ..operators.ranks import numbered
from ..storage import stored


class Aligned(NamedTuple):
    """Tables over the same cells, with codes from 0; and what a log item that is absent from a cell counts as."""

    metrics: DataFrame
    logs: DataFrame
    edges: DataFrame
    labels: DataFrame
    segments: DataFrame
    background: DataFrame
    sizes: records.Sizes


def log_items(templates: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of templates (D1), levels (D2) and lines (D3) as one long table (bucket_ms, service, item, n), and the items' codes (item, code).

    Templates stand first, by number, then levels as they are listed, then the total; that is the outer alignment (C7) in long form.
    """
    names = [c for c in levels.columns if c not in ("bucket_ms", "service")]
    wide = levels.select("bucket_ms", "service", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("long") for c in names)))).alias("item", "n"))
    of_templates = templates.select("bucket_ms", "service", F.format_string("template_%d", "template_id").alias("item"), "n")
    codes = numbered(templates.select("template_id").distinct(), ("template_id",), "code")
    n = codes.count()
    fixed = templates.sparkSession.createDataFrame([(c, n + i) for i, c in enumerate(names)], "item string, code long")
    return of_templates.unionByName(wide), codes.select(F.format_string("template_%d", "template_id").alias("item"), "code").unionByName(fixed)


def load_raw(
    points: DataFrame, labels: DataFrame, logs: DataFrame, edges: DataFrame, items: DataFrame, step: int = 30_000, w: int = 10, percent: float = 0.5, features: int = 0, first: int = 0
) -> Aligned:
    """Metrics (ts_ms, service, feature, value), labels (bucket_ms, service, y), log counts (bucket_ms, service, item, n) and edge sums
    (bucket_ms, src, dst, status_code, duration_sum) to aligned tables.

    Cells with labels and metrics count (C5), the ``first`` of them if wanted (F2). Each service gives as many of its metrics, by name, as the one
    with the fewest has, or ``features`` if that is less (B14), averaged per cell (D7), absent ones 0 (C6). Labels are masked (E5) over those cells,
    log counts scaled by item (D12c) and edges by ten times their mean over all cells (D13). Services without labels are left out.
    """
    known = stored(labels.select("bucket_ms", "service", "y"), "labels")
    services = stored(joins.dictionary_of(known, "service", "node"), "nodes")
    sampled = joins.encode(points.withColumn("bucket_ms", scalars.bucket(F.col("ts_ms"), step)), "service", services, "node")
    sampled = joins.on_grid(sampled, known, ["bucket_ms"])
    names = numbered(sampled.select("node", "feature").distinct(), ("feature",), "code", keys=("node",))
    kept = stored(aggregates.mean_by(sampled.withColumn("value", scalars.finite(F.col("value"))), ["bucket_ms", "node", "feature"]).join(names, ["node", "feature"]), "metrics")
    least = kept.groupBy("node").agg((F.max("code") + 1).alias("n")).agg(F.min("n")).first()[0] or 0
    features = min(features or least, least)
    cells = kept.select("bucket_ms").distinct()
    cells = stored(cells.orderBy("bucket_ms").limit(first) if first else cells, "grid")
    grid = joins.densify(
        kept.where(F.col("code") < features).select("bucket_ms", "node", F.col("code").alias("feature"), "value"), cells,
        services.select("node").crossJoin(cells.sparkSession.range(features).withColumnRenamed("id", "feature")), ["value"],
    )
    marked = joins.encode(joins.on_grid(known, cells, ["bucket_ms"]), "service", services, "node")
    masked = series.mask_labels(marked, node="node", w=w, percent=percent)
    counts = joins.encode(joins.encode(joins.on_grid(logs, cells, ["bucket_ms"]), "service", services, "node"), "item", items.withColumnRenamed("code", "number"), "number")
    counts = stored(counts.select("bucket_ms", "node", "number", "n"), "logs")
    scaled = aggregates.scale_counts(counts, ["number"])
    bounds = counts.groupBy("number").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    background = bounds.select(F.col("number").alias("item"), (-F.col("low") / (F.col("high") - F.col("low") + 1e-6)).alias("value"))
    edges = stored(edges.select("bucket_ms", "src", "dst", "status_code", "duration_sum"), "edges")
    kinds = stored(joins.dictionary_of(edges, "status_code", "kind"), "kinds")
    known_edges = edges.join(services.select(F.col("service").alias("src"), F.col("node").alias("a")), "src").join(services.select(F.col("service").alias("dst"), F.col("node").alias("b")), "dst")
    sums = joins.on_grid(known_edges, cells, ["bucket_ms"]).join(kinds, "status_code").groupBy("bucket_ms", F.col("a").alias("src"), F.col("b").alias("dst"), "kind").agg(F.sum("duration_sum").alias("duration_sum"))
    spread = aggregates.scale_by_mean(sums, max(cells.count(), 1), ("src", "dst", "kind"))
    sizes = records.Sizes(services.count(), features, items.count(), kinds.count())
    return Aligned(
        grid, scaled.select("bucket_ms", "node", F.col("number").alias("item"), F.col("scaled").alias("value")), spread.select("bucket_ms", "src", "dst", "kind", F.col("scaled").alias("value")),
        masked.select("bucket_ms", "node", "y", "y_seen"), series.segments(cells, step=step), background, sizes,
    )


def window_dataset(aligned: Aligned, w: int = 10, stride: int = 1) -> DataFrame:
    """L2's windows of aligned tables: ``records.window_records``."""
    cells = stored(records.cell_rows(aligned.metrics, aligned.logs, aligned.edges, aligned.labels, aligned.sizes), "cells")
    return records.window_records(cells, aligned.segments, aligned.sizes, w, stride)
