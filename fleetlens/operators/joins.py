"""Joins: span edges, nested traces, intervals on a grid, alignment, dictionaries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import bucket
from ..storage import stored
from .ranks import numbered


def last_spans(spans: DataFrame, order: list[Column]) -> DataFrame:
    """Of spans with the same (trace_id, span_id), the last by ``order``: a map-side maximum over a struct."""
    rest = [c for c in spans.columns if c not in ("trace_id", "span_id")]
    keyed = spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return keyed.select("trace_id", "span_id", *(F.col(f"_s.{c}").alias(c) for c in rest))


def span_edges(spans: DataFrame, order: list[Column], step: int = 30_000, entities: list[str] | None = None) -> DataFrame:
    """C1. (trace_id, bucket_ms, src, dst, status_code, duration_s) of each child span whose parent runs in another service.

    Duplicate span ids are resolved by ``order`` for parents; every child row counts.
    """
    if entities:
        spans = spans.where(F.col("service_name").isin(*entities))
    parents = last_spans(spans, order).select("trace_id", F.col("span_id").alias("parent_id"), F.col("service_name").alias("src"))
    joined = spans.select("trace_id", "parent_id", "service_name", "status_code", "start_ms", "end_ms").join(parents, ["trace_id", "parent_id"]).where(F.col("src") != F.col("service_name"))
    return joined.select("trace_id", bucket(F.col("start_ms"), step).alias("bucket_ms"), "src", F.col("service_name").alias("dst"), "status_code", ((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)).alias("duration_s"))


#: Spans that a task brings together before it hands them on
MOST_ROWS = 5000
SPAN_FIELDS = "span_id string, parentspan_id string, parent_host string, host string, name string, start string, stop string, position long"


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _stamp(info: dict, part: str) -> str | None:
    """The timestamp of the first event whose key holds ``part``."""
    event = next((v for k, v in info.items() if part in k), None)
    return _text(event.get("timestamp")) if isinstance(event, dict) else None


def _spans_of(body: str | None) -> Iterator[tuple]:
    """(trace_id, fields of SPAN_FIELDS, reason) of everything below a trace's root, depth first; a reason for what is no span."""
    none = (None,) * 7
    try:
        root = json.loads(body or "")
    except (ValueError, RecursionError):
        root = None
    if not isinstance(root, dict):
        yield None, *none, 0, "unparsable"
        return
    listed = lambda x: iter(x if isinstance(x, list) else [])
    trace, position, ahead = _text(root.get("trace_id")), 0, [(listed(root.get("children")), "start")]
    while ahead:
        spans, parent = ahead[-1]
        span = next(spans, ahead)
        if span is ahead:
            ahead.pop()
            continue
        info = span.get("info") if isinstance(span, dict) else None
        info = info if isinstance(info, dict) else {}
        host, start = _text(info.get("host")), _stamp(info, "-start")
        ids = (_text(span.get("trace_id")), _text(span.get("parent_id"))) if isinstance(span, dict) else (None, None)
        yield trace, *ids, parent, host, _text(info.get("name")), start, _stamp(info, "-stop"), position, "no host" if host is None else "no start" if start is None else None
        position += 1
        if isinstance(span, dict):
            ahead.append((listed(span.get("children")), host))


def walk_traces(traces: DataFrame, body: str = "body") -> DataFrame:
    """C2. The other columns, trace_id, the spans' fields and ``reason``: every span of nested JSON traces of any depth, and what is no span.

    One read, one pass, ``MOST_ROWS`` spans at a time. ``reason`` is null for a span. A text that is no JSON object has one row, 'unparsable'; a span without
    a host or a start has its row with 'no host' or 'no start', and the spans below it are walked like any others.
    """
    kept = [f for f in traces.schema.fields if f.name != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, rows: list[tuple], owners: list[int]) -> pa.RecordBatch:
            own = [batch.column(f.name).take(pa.array(owners, pa.int64())) for f in kept]
            values = [pa.array(c, pa.int64() if n == 8 else pa.string()) for n, c in enumerate(zip(*rows))]
            return pa.RecordBatch.from_arrays(own + values, names=[f.name for f in kept] + ["trace_id", *(f.split()[0] for f in SPAN_FIELDS.split(", ")), "reason"])

        for batch in batches:
            rows, owners = [], []
            for i, text in enumerate(batch.column(body)):
                for row in _spans_of(text.as_py()):
                    rows.append(row)
                    owners.append(i)
                    if len(rows) == MOST_ROWS:  # within a trace too
                        yield made(batch, rows, owners)
                        rows, owners = [], []
            if rows:
                yield made(batch, rows, owners)

    schema = StructType(kept + StructType.fromDDL(f"trace_id string, {SPAN_FIELDS}, reason string").fields)
    return traces.select(*(f.name for f in kept), body).mapInArrow(run, schema)


def flatten_traces(traces: DataFrame, body: str = "body") -> DataFrame:
    """C2. The spans of ``walk_traces``: ``parent_host`` is that of the enclosing span, 'start' right below a root; a missing stop is null.

    ``position`` numbers what a trace holds depth first. ``split_traces`` gives what is left out here.
    """
    return walk_traces(traces, body).where("reason is null").drop("reason")


def split_traces(traces: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """C2. The spans, and a quarantine of what is none, from one walk that is kept."""
    walked = stored(walk_traces(traces, body), "traces")
    return walked.where("reason is null").drop("reason"), walked.where("reason is not null")


def intervals_to_grid(events: DataFrame, step: int = 30_000, entities: list[str] | None = None, chunk: int = 10_000) -> DataFrame:
    """C3. (bucket_ms, service, anomaly_type, idx): every grid cell that an event's [st_ms, ed_ms] touches.

    Both ends are floored and included. Events without an end, with an end before the start or of type
    [normal] mark nothing. Events are cut into stretches of ``chunk`` cells before their cells are listed, so no
    array is longer than that however long an event lasts.
    """
    first, last = bucket(F.col("st_ms"), step), bucket(F.col("ed_ms"), step)
    valid = events.where((F.col("ed_ms") >= F.col("st_ms")) & (F.col("anomaly_type") != "[normal]"))
    if entities:
        valid = valid.where(F.col("service").isin(*entities))
    cells = lambda a, z, width: F.explode(F.sequence(a, z, F.lit(width).cast("long")))
    stretches = valid.select("service", "anomaly_type", "idx", last.alias("_last"), cells(first, last, step * chunk).alias("_from"))
    ends = F.least("_last", F.col("_from") + step * (chunk - 1))
    return stretches.select(cells(F.col("_from"), ends, step).alias("bucket_ms"), "service", "anomaly_type", "idx")


def fan_out(metrics: DataFrame, ip_map: DataFrame, system: str = "system") -> DataFrame:
    """C4. Metrics of a host (service ``system``) once for each service on its ip, as host_<feature>; others as they are.

    Of a service's ips that have a feature the smallest gives it.
    """
    direct = metrics.where(F.col("service") != system)
    hosts = metrics.where(F.col("service") == system).drop("service")
    order = F.transform(F.split("ip", r"\."), lambda x: x.try_cast("int"))
    pairs = hosts.select("ip", "feature").distinct().join(ip_map.select("ip", "service").distinct(), "ip")
    chosen = pairs.groupBy("service", "feature").agg(F.min_by("ip", F.struct(order, "ip")).alias("ip"))
    fanned = hosts.join(chosen, ["ip", "feature"])
    return direct.unionByName(fanned.withColumn("feature", F.concat(F.lit("host_"), "feature")).select(*direct.columns))


def on_grid(df: DataFrame, grid: DataFrame, on: list[str]) -> DataFrame:
    """C5. Rows whose key stands in ``grid``."""
    return df.join(grid.select(*on).distinct(), on, "left_semi")


def densify(df: DataFrame, grid: DataFrame, entities: DataFrame, values: list[str], fill: float = 0) -> DataFrame:
    """C6. A row for every cell of ``grid`` and every one of ``entities``, missing values filled.

    The product is the result itself.
    """
    keys = grid.columns + entities.columns
    every = grid.crossJoin(entities)
    return every.join(df.select(*keys, *values), keys, "left").fillna(fill, values)


def align(dfs: list[DataFrame], on: list[str], how: str = "full_outer") -> DataFrame:
    """C7 (full_outer), C8 (inner). Wide frames joined on their keys."""
    return reduce(lambda a, b: a.join(b, on, how), dfs)


def complete_keys(points: DataFrame, key: str, feature: str) -> DataFrame:
    """C8, long form. Points whose key has every feature."""
    n = points.agg(F.count_distinct(feature)).first()[0]
    whole = points.groupBy(key).agg(F.count_distinct(feature).alias("_n")).where(F.col("_n") == n).select(key)
    return points.join(whole, key, "left_semi")


def encode(df: DataFrame, col: str, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """C9. Add the code of ``col`` from ``dictionary`` (col, code); rows without one go."""
    return df.join(dictionary.select(col, code), col)


def dictionary_of(df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """C9, D19. Distinct values in order and their numbers from 0."""
    return numbered(df.select(col).where(F.col(col).isNotNull()).distinct(), (col,), code).select(col, code)


def on_edges(df: DataFrame, graph: DataFrame) -> DataFrame:
    """C11. Features of the edges that the graph has."""
    return df.join(graph.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
