"""The windowed training set: short segments, strides, blocks of any size, dense arrays from sparse ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import records, series
from fleetlens.plans import dataset

SIZES = records.Sizes(2, 2, 3, 2)


@pytest.fixture(scope="module")
def tables(spark):
    """Cells 0 to 11 but 6 to 9 apart: segments of six, and of two, which is too short."""
    cells = [0, 1, 2, 3, 4, 5, 10, 11]
    rng = np.random.default_rng(4)
    metrics = [(t, n, f, float(rng.integers(1, 9))) for t in cells for n in range(2) for f in range(2)]
    logs = [(t, n, i, float(t + n + i)) for t in cells for n in range(2) for i in range(3) if (t + n + i) % 3 == 0]
    edges = [(t, t % 2, 1 - t % 2, 1, 0.5 * t) for t in cells if t % 2]
    labels = [(t, n, int((t + n) % 4 == 0), int((t + n) % 4 == 0) if t < 4 else 2) for t in cells for n in range(2)]
    make = lambda rows, names: spark.createDataFrame(rows, names)
    frames = (
        make(metrics, "bucket_ms long, node int, feature int, value double"), make(logs, "bucket_ms long, node int, item int, value double"),
        make(edges, "bucket_ms long, src int, dst int, kind int, value double"), make(labels, "bucket_ms long, node int, y int, y_seen int"),
    )
    return frames, series.segments(make([(t,) for t in cells], "bucket_ms long"), step=1)


def arrays(tables):
    dense = np.zeros((12, 2, 2)), np.zeros((12, 2, 3)), np.zeros((12, 2, 2, 2))
    for frame, out in zip(tables[0], dense):
        for t, *place, value in frame.collect():
            out[(t, *place)] = value
    return dense


@pytest.mark.parametrize("blocks", [2, 3, 40])
@pytest.mark.parametrize("stride", [1, 2])
def test_records_are_the_dense_windows(tables, blocks, stride):
    frames, segments = tables
    got = records.window_records(records.cell_rows(*frames, SIZES), segments, SIZES, 3, stride, blocks=blocks)
    metrics, logs, edges = arrays(tables)
    ends = list(range(2, 6, stride))
    whole = got.select("*", records.densified(F.col("data_log"), 18).alias("l"), records.densified(F.col("data_edge"), 24).alias("e")).orderBy("window_id").collect()
    assert [(r["window_id"], r["segment"], r["end_ts"]) for r in whole] == [(i, 0, t) for i, t in enumerate(ends)]
    for r, t in zip(whole, ends):
        cut = slice(t - 2, t + 1)
        assert r["data_node"] == metrics[cut].ravel().tolist() and r["l"] == logs[cut].ravel().tolist() and r["e"] == edges[cut].ravel().tolist()
        assert len(r["data_edge"]) == (edges[cut] != 0).sum() and r["traces"] == edges[cut].sum()
        assert r["real"] == [int((t + n) % 4 == 0) for n in range(2)] and r["cls"] == (r["real"] if t < 4 else [2, 2])
        assert r["visible"] == r["cls"].count(1) and r["anomalies"] == r["real"].count(1)


def test_background_of_absent_entries(spark):
    row = spark.range(1).select(F.array(F.struct(F.lit(1).cast("long").alias("index"), F.lit(9.0).alias("value"))).alias("s"))
    assert row.select(records.densified(F.col("s"), 4, F.array(F.lit(-1.0), F.lit(-2.0)))).first()[0] == [-1.0, 9.0, -1.0, -2.0]


def test_alignment(spark):
    """Cells need a label and a metric, all services give as many metrics as the poorest, absent ones are 0."""
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    points = frame([(0, "a", "x", 2.0), (1, "a", "x", 4.0), (0, "a", "y", 7.0), (10, "b", "z", 5.0), (20, "a", "x", 1.0), (30, "a", "x", 8.0), (0, "other", "x", 1.0)], "ts_ms long, service string, feature string, value double")
    labels = frame([(t, s, int(t == 10)) for t in (0, 10, 20) for s in ("a", "b")], "bucket_ms long, service string, y int")
    logs = frame([(0, "a", "template_1", 3), (10, "b", "template_1", 5), (40, "a", "template_1", 99), (0, "b", "log_total", 2)], "bucket_ms long, service string, item string, n long")
    items = frame([("template_1", 0), ("log_total", 1)], "item string, code long")
    edges = frame([(0, "a", "b", "200", 4.0), (0, "a", "b", "200", 2.0), (40, "a", "b", "200", 50.0), (10, "b", "gone", "500", 1.0)], "bucket_ms long, src string, dst string, status_code string, duration_sum double")
    got = dataset.load_raw(points, labels, logs, edges, items, 10, w=1)
    assert got.sizes == records.Sizes(2, 1, 2, 2)
    assert sorted(map(tuple, got.metrics.select("bucket_ms", "node", "feature", "value").collect())) == [(0, 0, 0, 3.0), (0, 1, 0, 0.0), (10, 0, 0, 0.0), (10, 1, 0, 5.0), (20, 0, 0, 1.0), (20, 1, 0, 0.0)]
    assert sorted((r[0], r[1], r[2], round(r[3], 4)) for r in got.logs.collect()) == [(0, 0, 0, 0.0), (0, 1, 1, 0.0), (10, 1, 0, 1.0)]
    assert {r["item"]: round(r["value"], 3) for r in got.background.collect()} == {0: -1.5, 1: -2e6}
    assert [tuple(r)[:4] + (round(r[4], 4),) for r in got.edges.collect()] == [(0, 0, 1, 0, 0.3)]
    assert got.segments.count() == 3 and dataset.load_raw(points, labels, logs, edges, items, 10, first=2).segments.count() == 2


def test_items_in_numeric_order(spark):
    templates = spark.createDataFrame([(0, "a", 10, 1), (0, "a", 2, 4)], "bucket_ms long, service string, template_id long, n long")
    levels = spark.createDataFrame([(0, "a", 3, 5)], "bucket_ms long, service string, level_info long, log_total long")
    logs, items = dataset.log_items(templates, levels)
    assert sorted(map(tuple, items.collect()), key=lambda r: r[1]) == [("template_2", 0), ("template_10", 1), ("level_info", 2), ("log_total", 3)]
    assert sorted((r["item"], r["n"]) for r in logs.collect()) == [("level_info", 3), ("log_total", 5), ("template_10", 1), ("template_2", 4)]
