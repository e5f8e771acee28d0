"""Lifecycles: raw telemetry to aligned tables, and aligned tables to scores and metrics.

What several branches of a lifecycle read is written to the shared folder once; the rest is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, joins, scoring, series, templates
from ..storage import stored


def metric_table(points: DataFrame, ip_map: DataFrame | None = None, step: int = 30_000, n_grid: int | None = None) -> DataFrame:
    """Metric points (ts_ms, service, feature, value[, ip]) to (bucket_ms, service, feature, value) in [0, 1].

    Host metrics are fanned out, equal timestamps reduced, cores averaged, poor and flat features left out,
    cells averaged, gaps of up to 10 cells filled and every series scaled to its range.
    """
    if ip_map is not None:
        points = joins.fan_out(points, ip_map)
    single = aggregates.reduce_duplicates(points).where("value is not null").withColumn("feature", scalars.canonical_feature(F.col("feature")))
    merged = stored(aggregates.mean_by(single, ["ts_ms", "service", "feature"]), "metrics")
    cell = scalars.bucket(F.col("ts_ms"), step)
    if n_grid is None:
        n_grid = merged.agg(F.count_distinct(cell)).first()[0]
    good = stored(aggregates.quality_filter(aggregates.metric_quality(merged, n_grid, step)), "series")
    shared = series.common_features(good)
    kept = merged.join(good.select("service", "feature"), ["service", "feature"], "left_semi").join(shared, "feature", "left_semi")
    cells = stored(aggregates.mean_by(kept.withColumn("bucket_ms", cell), ["bucket_ms", "service", "feature"]), "cells")
    grid, names = cells.select("bucket_ms").distinct(), cells.select("service", "feature").distinct()
    dense = grid.crossJoin(names).join(cells, ["bucket_ms", "service", "feature"], "left")
    filled = stored(series.ffill(dense, ["service", "feature"], ["bucket_ms"], "value"), "filled")
    return aggregates.min_max(aggregates.drop_flat(filled), ["service", "feature"]).select("bucket_ms", "service", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))


def label_table(faults: DataFrame, grid: DataFrame, services: DataFrame, step: int = 30_000, zone: str = "UTC") -> DataFrame:
    """Fault messages to a label for every (bucket_ms, service) of the grid: y and the types met."""
    events = stored(scalars.classify_fault(faults, zone=zone).select("idx", "service", "anomaly_type", "st_ms", "ed_ms"), "events")
    cells = aggregates.labels_by_cell(joins.intervals_to_grid(events, step))
    every = grid.crossJoin(services)
    return every.join(cells, ["bucket_ms", "service"], "left").select("bucket_ms", "service", F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def log_table(messages: DataFrame, step: int = 30_000, zone: str = "UTC", profile: dict = templates.SERVICE_PROFILE) -> tuple[DataFrame, DataFrame]:
    """Log messages to counts per (bucket_ms, service, template) and the numbered template dictionary; the profile gives masks and delimiters."""
    parsed, _ = scalars.split_rejects(scalars.parse_log_header(messages, zone=zone))
    masked = stored(templates.leaves(parsed, **profile).select("line_id", "ts_ms", "service", "leaf", "tokens"), "masked")  # mined and matched: masked once
    dictionary = stored(templates.assign_ids(templates.mine_templates(masked)), "dictionary")
    numbered = masked.join(templates.match_templates(masked, dictionary), "line_id")
    return aggregates.template_counts(numbered, step), dictionary


def edge_table(spans: DataFrame, order: list[Column], step: int = 30_000) -> tuple[DataFrame, DataFrame]:
    """Spans to edge statistics per cell, and the service graph."""
    edges = joins.span_edges(spans, order, step)
    return aggregates.edge_stats(edges), aggregates.service_graph(edges)


def score_metrics(cells: DataFrame, labels: DataFrame, alpha: float = 0.7, w: int = 10, frac: float = 0.7) -> DataFrame:
    """Scaled cells and labels to (bucket_ms, service, y, p_cls, prob, score, predicted) of the test part.

    Energy is the distance to the mean of the steps before; the classifier learns from the visible labels of the
    first part; both are fused.
    """
    energy = scoring.residual_energy(cells, w, ts="bucket_ms")
    seen = series.mask_labels(labels.select("bucket_ms", "service", "y"), w=w)
    rows = stored(series.chrono_split(energy.join(seen, ["bucket_ms", "service"]), "bucket_ms", frac), "rows")  # read by every step of the fit
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    scored = scoring.robust_prob(scoring.residual_classifier(train, test, ["energy"]), "energy")
    scored = scored.withColumn("score", scoring.fuse(F.col("p_cls"), F.col("prob"), alpha))
    return scored.select("bucket_ms", "service", "y", "p_cls", "prob", "score", scoring.decide(F.col("score")).alias("predicted"))
