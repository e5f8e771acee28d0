"""Outputs by parts, fitted states that add up, hosts' windows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars
from fleetlens.operators import aggregates, fitted, joins, scoring
from fleetlens.plans import hosts
from fleetlens.sources import files


def test_one_changed_file_rewrites_one_part(spark, tmp_path):
    source, output = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write = lambda name, text: (source / name).write_text(f"v\n{text}\n")
    for name in ("a_1.csv", "a_2.csv", "b_1.csv", "c_1.csv"):
        write(name, name[2])
    part_of = lambda p: F.regexp_extract(p, r"([^/_]+)_[^/]*$", 1)
    build = lambda paths: spark.read.csv(paths, header=True, schema="v long").withColumn("part", part_of(F.col("_metadata.file_path"))).groupBy("part").agg(F.sum("v").alias("v"))
    run = lambda: files.materialize_parts(spark, output, [str(source)], part_of, build)
    held = lambda: {d: sorted(os.listdir(os.path.join(output, d))) for d in os.listdir(output) if d.startswith("part=")}
    rows = lambda: {r["part"]: r["v"] for r in spark.read.parquet(output).collect()}
    assert run() == ["a", "b", "c"] and rows() == {"a": 3, "b": 1, "c": 1}
    first = held()
    assert run() == [] and held() == first
    write("b_1.csv", "50")
    assert run() == ["b"] and rows() == {"a": 3, "b": 50, "c": 1}
    assert {d for d in first if held()[d] != first[d]} == {"part=b"}
    write("a_3.csv", "7")
    os.remove(source / "c_1.csv")
    assert run() == ["a", "c"] and rows() == {"a": 10, "b": 50} and run() == []


@pytest.fixture(scope="module")
def parts(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice("abc") if i < 150 else draw.choice("abcd"), draw.randrange(50) * 0.5) for i in range(300)]
    frame = spark.createDataFrame(rows, "i long, k string, value double").cache()
    return frame, frame.where("i < 100"), frame.where("i >= 100 and i < 200"), frame.where("i >= 200")


def same(a, b):
    assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))


def test_ranges_fitted_in_parts(parts):
    every, one, two, rest = parts
    state = fitted.added(fitted.fit_ranges(one, ["k"]), fitted.fit_ranges(two, ["k"]), ["k"])
    for flat in (False, True):
        wanted = aggregates.min_max(every, ["k"], flat_to_zero=flat, fit_on=F.col("i") < 200).where("i >= 200")
        same(fitted.scaled_to(rest, state, ["k"], flat_to_zero=flat), wanted)
    same(fitted.counts_scaled_to(rest, state, ["k"], "value"), aggregates.scale_counts(every, ["k"], "value", fit_on=F.col("i") < 200).where("i >= 200"))


def test_totals_fitted_in_parts(parts):
    every, one, two, rest = parts
    state = fitted.added(fitted.fit_totals(one, ["k"], 40), fitted.fit_totals(two, ["k"], 60), ["k"])
    same(fitted.divided_by(rest, state, ["k"], "value"), aggregates.scale_by_mean(every, 100, ("k",), "value", fit_on=F.col("i") < 200).where("i >= 200"))


def test_constants_fitted_in_parts(parts):
    every, one, two, rest = parts
    state = fitted.constants_of(fitted.added(fitted.fit_counts(one, "value"), fitted.fit_counts(two, "value"), ["value"]))
    known = scoring.robust_constants(every.where("i < 200"), "value")
    assert tuple(state.first()) == known
    same(fitted.prob_by(rest, "value", state), scoring.robust_prob(rest, "value", known))


def test_dictionaries_keep_their_codes(spark, parts):
    every, one, _, rest = parts
    saved = joins.dictionary_of(one.where("k <> 'a'"), "k")
    assert {r["k"]: r["code"] for r in fitted.extended(saved, every, "k").collect()} == {"b": 0, "c": 1, "a": 2, "d": 3}
    same(fitted.extended(fitted.extended(saved, rest, "k"), every, "k"), fitted.extended(saved, every, "k"))


def test_absent_files_are_reported(spark, tmp_path):
    (tmp_path / "log_a.csv").write_text("x\n1\n")
    schema = spark.createDataFrame([], "x long").schema
    with pytest.warns(UserWarning, match="log_b.csv"):
        frame = files.read_entities(spark, str(tmp_path), "log_{entity}.csv", ["a", "b"], schema)
    assert frame.count() == 1 and files.absent_entities(spark, str(tmp_path), "log_{entity}.csv", ["a", "b"]) == ["b"]


def test_windows_of_hosts(spark):
    """Every second from 0 to 5 is a step; the metric of second 2 and 3 is that of second 1; a host without metrics is left out."""
    make = spark.createDataFrame
    metrics = make([(0, "h", "cpu", 0.5), (1, "h", "cpu", 0.25), (4, "h", "cpu", 1.0), (5, "h", "cpu", 0.0), (0, "g", "cpu", 0.75)], "ts long, host string, feature string, value double")
    logs = make([(1, "h", 2, 4), (3, "g", 1, 2), (9, "h", 1, 1), (3, "z", 1, 1)], "ts long, host string, template_id long, n long")
    spans = make([("h", "g", "op", 2, 3.0), ("h", "g", "op", 2, 1.0), ("start", "h", "op", 2, 9.0), ("h", "g", "op", 7, 9.0)], "parent_host string, host string, name string, end_s long, duration_s double")
    labels = make([(t, h, int(t == 4)) for t in range(6) for h in "gh"], "ts long, host string, y int")
    aligned = hosts.host_aligned(metrics, logs, spans, labels, w=3)
    got = hosts.host_windows(aligned, 3).orderBy("window_id").collect()
    assert [(r["window_id"], r["end_ts"]) for r in got] == [(0, 2), (1, 3), (2, 4), (3, 5)]
    assert got[1]["data_node"] == [0.75, 0.25] * 3 and got[3]["data_node"] == [0.75, 0.25, 0.75, 1.0, 0.75, 0.0]
    assert [[(e["index"], round(e["value"], 3)) for e in r["data_log"]] for r in got] == [[(7, 1.0)], [(3, 1.0), (8, 1.0)], [(4, 1.0)], [(0, 1.0)]]
    assert [[(e["index"], round(e["value"], 3)) for e in r["data_edge"]] for r in got] == [[(10, 0.6)], [(6, 0.6)], [(2, 0.6)], []]
    assert [r["anomalies"] for r in got] == [0, 0, 2, 0]


def test_host_metrics_and_logs(spark):
    points = spark.createDataFrame([("2021-01-01 00:00:01 CEST", h, f, v) for h, f, v in (("a", "x", 1.0), ("a", "x", 3.0), ("b", "x", 5.0))] + [("2021-01-01 00:00:02 CEST", "a", "x", 4.0), ("2021-01-01 00:00:02 CEST", "b", "x", 5.0), ("2021-01-01 00:00:03 CEST", "a", "x", 0.0)], "now string, host string, feature string, value double")
    base = 1609459200 - 3600
    got = hosts.host_metrics(points, base, base + 10)
    assert sorted(map(tuple, got.collect())) == [(base + 1, "a", "x", 0.5), (base + 1, "b", "x", 0.0), (base + 2, "a", "x", 1.0), (base + 2, "b", "x", 0.0)]
    lines = spark.createDataFrame([(i, f"2021-01-01 00:00:0{i}.123 +02:00x", "a", p) for i, p in enumerate(['executed cmd "ls"', 'executed cmd "rm"', "other"])], "line_id long, now string, host string, payload string")
    counts, dictionary = hosts.host_logs(lines.withColumn("now", F.concat(F.left("now", F.lit(19)), F.lit(".123 +02:0"))).withColumn("now", F.concat(F.left("now", F.lit(19)), F.lit("0123456789"))), base, base + 1)
    assert sorted(map(tuple, counts.collect())) == [(base, "a", 1, 1), (base + 1, "a", 1, 1), (base + 2, "a", 2, 1)]
    assert {" ".join(r["template"]) for r in dictionary.collect()} == {"executed cmd <:CMD:>", "other"}
