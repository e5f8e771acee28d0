"""L3: the host profile. Raw metrics, logs and traces of hosts on a grid of seconds, and their windows.

Times are local and are read in ``zone``; metrics and logs are ``offset_s`` seconds ahead of traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, joins, records, series, templates
from ..storage import stored
from .dataset import Aligned

OFFSET_S = 3600


def seconds(text: Column, zone: str, offset_s: int = 0) -> Column:
    """B1b. Epoch seconds of a local time."""
    return F.floor(scalars.epoch_ms(text, zone, offset_s) / 1000)


def host_metrics(points: DataFrame, lo: int, hi: int, zone: str = "UTC", offset_s: int = OFFSET_S, suffix: int = 5) -> DataFrame:
    """(ts, host, feature, value) from (now, host, feature, value), ``now`` a local time with a suffix.

    Means per time (D7), scaled per series over all times (D12b), times that every series has (C8), seconds (B6, B1b), the range (B3).
    """
    means = stored(aggregates.mean_by(points.withColumn("value", scalars.finite(F.col("value"))), ["now", "host", "feature"]), "means")
    scaled = aggregates.min_max(means, ["host", "feature"], flat_to_zero=True).withColumn("_series", F.struct("host", "feature"))
    whole = scalars.strip_suffix(joins.complete_keys(scaled, "now", "_series"), "now", suffix)
    return scalars.time_range(whole.withColumn("ts", seconds(F.col("now"), zone, offset_s)), "ts", lo, hi).select("ts", "host", "feature", "value")


def host_logs(lines: DataFrame, lo: int, hi: int, zone: str = "UTC", offset_s: int = OFFSET_S, suffix: int = 10, profile: dict = templates.HOST_PROFILE) -> tuple[DataFrame, DataFrame]:
    """(ts, host, template_id, n) and the dictionary from (line_id, now, host, payload): B6, B1b, B3 with one second more, G1, G3, C10, D1."""
    timed = scalars.strip_suffix(lines, "now", suffix).withColumn("ts", seconds(F.col("now"), zone, offset_s))
    timed = stored(scalars.time_range(timed, "ts", lo, hi, 1).select("line_id", "ts", "host", "payload"), "lines")
    dictionary = stored(templates.assign_ids(templates.mine_templates(timed, **profile)), "dictionary")
    known = timed.join(templates.match_templates(timed, dictionary, **profile).where("template_id is not null"), "line_id")
    return known.groupBy("ts", "host", "template_id").agg(F.count("*").alias("n")), dictionary


def host_spans(traces: DataFrame, lo: int, hi: int, zone: str = "UTC") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans (stem, span_id, parentspan_id, parent_host, host, name, start_s, end_s, duration_s), the graph of hosts, and the quarantine.

    C2; a missing end is that of the span before, over traces in file order (E1c); the graph is of all spans (D14), the range is
    that of ends (B3); durations keep microseconds (B11).
    """
    spans, rejects = joins.split_traces(traces)
    filled = stored(series.ffill(spans, [], ["stem", "position"], "stop", None), "spans")
    micros = lambda c: F.unix_micros(F.to_utc_timestamp(F.col(c).try_cast("timestamp"), zone))
    timed = filled.withColumns({"start_s": F.floor(micros("start") / 1_000_000), "end_s": F.floor(micros("stop") / 1_000_000), "duration_s": (micros("stop") - micros("start")) / 1e6})
    graph = aggregates.service_graph(filled.where("parent_host <> 'start'").select(F.col("parent_host").alias("src"), F.col("host").alias("dst")))
    kept = scalars.time_range(timed, "end_s", lo, hi)
    return kept.select("stem", "span_id", "parentspan_id", "parent_host", "host", "name", "start_s", "end_s", "duration_s"), graph, rejects


def host_aligned(metrics: DataFrame, logs: DataFrame, spans: DataFrame, labels: DataFrame, w: int = 10, percent: float = 0.5) -> Aligned:
    """Tables over every second from the first metric to the last: gaps filled (E2, E1b), counts scaled by buckets (D12c), edges by their mean (D4, D13), labels (ts, host, y) masked (E5).

    Hosts are those with metrics. Spans before the first or after the last second are left out.
    """
    metrics = stored(metrics, "metrics")
    hosts = stored(joins.dictionary_of(metrics, "host", "node"), "nodes")
    names = stored(joins.dictionary_of(metrics, "feature", "number"), "names")
    coded = joins.encode(joins.encode(metrics, "host", hosts, "node"), "feature", names, "number")
    span = metrics.agg(F.min("ts").alias("_a"), F.max("ts").alias("_z")).where("_a is not null")
    grid = stored(series.grid_of(span, [], "ts", 1), "grid")
    n = max(grid.count(), 1)
    values = coded.select("ts", "node", F.col("number").alias("feature"), "value")
    known = grid.crossJoin(values.select("node", "feature").distinct()).join(values, ["ts", "node", "feature"], "left")  # the product is the result
    filled = series.ffill(known, ["node", "feature"], ["ts"], "value", None).fillna(0.0, ["value"])
    counts = joins.encode(joins.on_grid(logs, grid, ["ts"]), "host", hosts, "node").withColumnRenamed("ts", "bucket_ms")
    scaled = aggregates.scale_counts(counts, ["template_id"], mode="buckets", n_grid=n)
    ends = spans.join(hosts.select(F.col("host"), F.col("node").alias("dst")), "host").join(hosts.select(F.col("host").alias("parent_host"), F.col("node").alias("src")), "parent_host")
    kinds = stored(joins.dictionary_of(spans, "name", "kind"), "kinds")
    sums = joins.on_grid(ends.withColumn("ts", F.col("end_s")), grid, ["ts"]).join(kinds, "name").groupBy("ts", "src", "dst", "kind").agg(F.sum("duration_s").alias("duration_sum"))
    spread = aggregates.scale_by_mean(sums, n, ("src", "dst", "kind"))
    masked = series.mask_labels(joins.encode(joins.on_grid(labels, grid, ["ts"]), "host", hosts, "node"), node="node", ts="ts", w=w, percent=percent)
    items = logs.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
    none = scaled.where(F.lit(False)).select(F.col("template_id").alias("item"), F.col("scaled").alias("value"))
    return Aligned(
        filled.select("ts", "node", "feature", "value"), scaled.select(F.col("bucket_ms").alias("ts"), "node", (F.col("template_id") - 1).alias("item"), F.col("scaled").alias("value")),
        spread.select("ts", "src", "dst", "kind", F.col("scaled").alias("value")), masked.select("ts", "node", "y", "y_seen"), grid.withColumn("segment", F.lit(0)), none,
        records.Sizes(hosts.count(), names.count(), items, kinds.count()),
    )


def host_windows(aligned: Aligned, w: int = 10, step: int = 1) -> DataFrame:
    """E4b. Windows of ``w`` seconds, each ``step`` seconds: ``records.window_records`` over the whole grid as one segment."""
    cells = stored(records.cell_rows(aligned.metrics, aligned.logs, aligned.edges, aligned.labels, aligned.sizes, "ts"), "cells")
    return records.window_records(cells, aligned.segments, aligned.sizes, w, step, "ts")
