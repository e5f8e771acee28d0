"""A7, E4, D21: windows of all modalities at once.

Each cell of the time grid becomes one row that holds its metrics, log counts, edges and labels; windows then run over cells, so the four
tables are brought together once per cell and never window by window. What is sparse stays so: logs and edges are lists of (index, value),
and an index says which entry of the window's dense array is meant, in row-major order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import with_frames
from .ranks import numbered

_ENTRY = "array<struct<index:bigint,value:double>>"


class Sizes(NamedTuple):
    """How many nodes, metrics of a node, log items and kinds of edges there are."""

    nodes: int
    features: int
    items: int
    kinds: int


def cell_rows(metrics: DataFrame, logs: DataFrame, edges: DataFrame, labels: DataFrame, sizes: Sizes, ts: str = "bucket_ms") -> DataFrame:
    """(ts, metrics, logs, edges, labels): one row for each cell that any of the tables has.

    From metrics (ts, node, feature, value), logs (ts, node, item, value), edges (ts, src, dst, kind, value) and labels (ts, node, y, y_seen), all
    with codes from 0. A cell's lists are as long as the fleet is large, and no longer for more time; all four are gathered by one grouping.
    """
    at = lambda *digits: sum(F.col(c).cast("long") * step for c, step in digits)
    entry = lambda index: F.struct(index.cast("long").alias("index"), F.col("value").cast("double").alias("value"))
    parts = [
        metrics.select(ts, entry(at(("node", sizes.features), ("feature", 1))).alias("m")),
        logs.select(ts, entry(at(("node", sizes.items), ("item", 1))).alias("l")),
        edges.select(ts, entry(at(("src", sizes.nodes * sizes.kinds), ("dst", sizes.kinds), ("kind", 1))).alias("e")),
        labels.select(ts, F.struct("node", "y", "y_seen").alias("y")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    gathered = lambda c: F.array_sort(F.collect_list(c))
    return rows.groupBy(ts).agg(gathered("m").alias("metrics"), gathered("l").alias("logs"), gathered("e").alias("edges"), gathered("y").alias("labels"))


def window_records(cells: DataFrame, segments: DataFrame, sizes: Sizes, w: int = 10, stride: int = 1, ts: str = "bucket_ms", blocks: int | None = None) -> DataFrame:
    """One row for each run of ``w`` cells within a segment, each ``stride`` cells; segments that are shorter have none.

    (window_id, segment, end_ts, data_node, data_log, data_edge, cls, real, visible, anomalies, traces): metrics as one dense array [w, node, feature],
    logs and edges as sparse ones of [w, node, item] and [w, node, node, kind], the visible and the real label of each node at the last step, how
    many nodes show an anomaly in either, and the sum of the edges.
    """
    placed = cells.join(segments, ts)
    if stride > 1:
        placed = numbered(placed, (ts,), "_place", 1 - w, ("segment",))
    step = F.struct("metrics", "logs", "edges")
    frames = lambda by: {"_rows": F.row_number().over(by), "_steps": F.collect_list(step).over(by.rowsBetween(1 - w, 0))}
    runs = with_frames(placed, ["segment"], [ts], w - 1, frames, blocks).where(F.col("_rows") >= w)
    if stride > 1:
        runs = runs.where(F.pmod(F.col("_place"), F.lit(stride)) == 0)
    dense = F.flatten(F.transform("_steps", lambda s: F.transform(s["metrics"], lambda x: x["value"])))

    def sparse(name: str, size: int) -> Column:
        moved = lambda s, t: F.transform(s[name], lambda x: F.struct((x["index"] + t.cast("long") * size).alias("index"), x["value"].alias("value")))
        return F.flatten(F.transform("_steps", moved)).cast(_ENTRY)

    last = lambda name: F.transform("labels", lambda x: x[name].cast("int"))
    ones = lambda name: F.size(F.filter("labels", lambda x: x[name] == 1))
    records = runs.select(
        "segment", F.col(ts).alias("end_ts"), dense.alias("data_node"), sparse("logs", sizes.nodes * sizes.items).alias("data_log"), sparse("edges", sizes.nodes**2 * sizes.kinds).alias("data_edge"),
        last("y_seen").alias("cls"), last("y").alias("real"), ones("y_seen").alias("visible"), ones("y").alias("anomalies"),
    )
    records = records.withColumn("traces", F.aggregate("data_edge", F.lit(0.0), lambda a, x: a + x["value"]))
    return numbered(records.select("end_ts"), ("end_ts",), "window_id").join(records, "end_ts")


def densified(entries: Column, size: int, background: Column | None = None) -> Column:
    """A sparse list as a dense array of ``size``, with zeros or a repeated ``background`` array where there is no entry."""
    known = F.map_from_entries(entries)
    other = F.lit(0.0) if background is None else None
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.coalesce(F.element_at(known, i), other if background is None else F.element_at(background, (i % F.size(background) + 1).cast("int"))))
