"""Small cases with results worked out by hand."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetlens.functions import scalars
from fleetlens.operators import aggregates, joins, ranks, scoring, series, templates
from fleetlens.sources import files
from fleetlens.streaming import rollups

AB = StructType([StructField("a", StringType()), StructField("b", StringType())])


@pytest.mark.parametrize(
    "text, rows",
    [
        ('a,b\n1,"x"\n2,"y"\n', [("1", "x"), ("2", "y")]),
        ('a,b\n1,"x"\n2,"cut off\n', [("1", "x")]),
        ('a,b\n1,"x"\n2,"cut\noff\nfurther\n', [("1", "x")]),
        ('a,b\n1,"two\nlines"\n2,"say ""hi"""\n', [("1", "two\nlines"), ("2", 'say "hi"')]),
        ("a,b\n", []),
    ],
)
def test_a1_truncated_csv(spark, tmp_path, text, rows):
    (tmp_path / "f.csv").write_text(text)
    assert sorted(map(tuple, files.read_tolerant_csv(spark, f"file://{tmp_path}", AB).collect())) == rows
    assert files.cut_records(spark, f"file://{tmp_path}").count() == text.count('"') % 2


def test_a2_a3_a3b_a4_file_names(spark, tmp_path):
    for name in ("svc1_10.0.0.1_docker_cpu_total_2021-07-01_2021-07-15", "system_10.0.0.2_load_2021-07-01_2021-07-15", "svc1_load_without_dates"):
        (tmp_path / f"{name}.csv").write_text("timestamp,value\n1625068800000,1.5\n1625068830000,bad\n")
    got = {(r["service"], r["ip"], r["feature"], r["value"]) for r in files.read_metric_files(spark, f"file://{tmp_path}").collect()}
    assert got == {("svc1", "10.0.0.1", "docker_cpu_total", 1.5), ("svc1", "10.0.0.1", "docker_cpu_total", None), ("system", "10.0.0.2", "load", 1.5), ("system", "10.0.0.2", "load", None)}
    hosts = files.host_of_file(spark.read.csv(f"file://{tmp_path}", header=True)).select("host", "stem").distinct().collect()
    assert {(r["host"], r["stem"]) for r in hosts} == {("svc1", "svc1_10.0.0.1_docker_cpu_total_2021-07-01_2021-07-15"), ("system", "system_10.0.0.2_load_2021-07-01_2021-07-15"), ("svc1", "svc1_load_without_dates")}
    some = files.read_entities(spark, f"file://{tmp_path}", "{entity}_*.csv", ["svc1", "gone"], AB)
    assert some.count() == 4
    assert files.read_entities(spark, f"file://{tmp_path}", "{entity}_*.csv", ["gone"], AB).count() == 0


def test_a6_to_a10_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    frame = spark.createDataFrame([("x", 1), ("y", 2)], "service string, v long")
    files.write_table(frame, f"{root}/t", ["service"])
    assert files.read_columns(spark, f"{root}/t", ["v"]).columns == ["v"]
    windows = files.number_windows(spark.createDataFrame([(30, "a"), (10, "a"), (30, "b")], "end_ts long, node string"), ["end_ts"])
    files.write_table(windows, f"{root}/w")
    assert [(r["window_id"], r["end_ts"]) for r in files.read_windows(spark, f"{root}/w", 2).collect()][0] == (0, 10)
    build = lambda: spark.read.parquet(f"{root}/t").select("v")
    assert files.materialize(spark, f"{root}/out", [f"{root}/t"], build)
    assert not files.materialize(spark, f"{root}/out", [f"{root}/t"], build)
    assert files.materialize(spark, f"{root}/out", [f"{root}/t"], build, force=True)
    import os
    import time

    part = next(p for p in (tmp_path / "t").rglob("*.parquet"))
    os.utime(part, (time.time() + 60, time.time() + 60))
    assert files.materialize(spark, f"{root}/out", [f"{root}/t"], build)
    for run in (1, 2):
        files.append_run(spark.createDataFrame([(run, 0.5)], "run int, f1 double"), f"{root}/runs")
    assert spark.read.parquet(f"{root}/runs").count() == 2


def test_b4_headers(spark):
    rows = ["2021-07-01 00:00:01,250 | INFO | x | hello ", "2021-07-01 00:00:01,250 no pipe", "no time | ERROR | z", "2021-07-01 00:00:01,001 | TRACE | t", "2021-07-01 00:00:01,001 | DEBUG |"]
    got = scalars.parse_log_header(spark.createDataFrame([(m,) for m in rows], "message string"), zone="Asia/Shanghai").collect()
    assert [(r["ts_ms"], r["level"], r["payload"]) for r in got] == [
        (1625068801250, "INFO", "hello"), (1625068801250, "UNKNOWN", rows[1]), (None, "ERROR", "z"), (1625068801001, "UNKNOWN", "t"), (1625068801001, "DEBUG", "")
    ]
    good, bad = scalars.split_rejects(scalars.parse_log_header(spark.createDataFrame([(m,) for m in rows], "message string")))
    assert (good.count(), bad.count()) == (4, 1)


def test_b5_every_rule(spark):
    head, at = "2021-07-01 00:00:01,250 | WARNING | s | ", 1625097601000
    start = "2021-07-01 00:00:09.500"
    cases = [
        ("2021-07-01 00:00:01,250 | INFO | s | ok", "[normal]", None, None, 0),
        ("2021-07-01 00:00:01,250 | ERROR | s | no", "[error_event]", at, at, 0),
        (head + f"[memory_anomalies] start at {start} and lasts 20 seconds", "[memory_anomalies]", at + 8500, at + 28500, 20),
        (head + "[memory_anomalies] lasts 20 seconds", "[memory_anomalies]", None, None, 20),
        (head + f"[cpu_anomalies] start at {start} and lasts 0 seconds", "[cpu_anomalies]", at + 8500, None, 0),
        (head + "[normal memory freed label]", "[normal memory freed label]", at + 250, at + 600250, 600),
        ("  " + head + "login failure, wait for 5 seconds", "[login failure]", at + 250, at + 5250, 5),
        (head + "simulate the login failure", "[login failure]", at + 250, at + 11250, 11),
        (head + f"trigger the file moving program start with {start}, last for 3 seconds", "[file moving program]", at + 8500, at + 11500, 3),
        (head + "access permission denied exception for an hour", "[access permission denied exception]", at + 250, at + 3600250, 3600),
        (head + "access permission denied exception lasts 7 seconds", "[access permission denied exception]", at + 250, at + 7250, 7),
        (head + "access permission denied exception", "[access permission denied exception]", at + 250, at + 3600250, 3600),
        (head + "strange", "[unknown_warning]", at + 250, at + 250, 0),
        ("2021-07-01 00:00:01,250 | DEBUG | s | x", "[unknown]", None, None, 0),
        (None, "[unknown]", None, None, 0),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, message string")
    got = scalars.classify_fault(frame).orderBy("i").collect()
    assert [(r["anomaly_type"], r["st_ms"], r["ed_ms"], r["duration_s"]) for r in got] == [c[1:] for c in cases]


def test_b7_masks(spark):
    cases = {
        "at 10.0.0.1 port 80": "at <:IP:> port <:NUM:>", "id aa:bb:cc:dd:ee x": "id <:ID:> x", "addr 0x1fA": "addr <:HEX:>", "abc1 -5": "abc1 <:NUM:>",
        "get http://a.b/c?d": "get http://<:URL:>", "uuid=xyz&k": "uuid=<:UUID:>&k", "query = select x": "query = <:QUERY:>", "user_name='bob'": "user_name='<:USERNAME:>'",
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = frame.select("t", scalars.mask_tokens(F.col("t"), scalars.COMMON_MASKS + scalars.SERVICE_MASKS).alias("m")).collect()
    assert {r["t"]: r["m"] for r in got} == cases
    assert frame.limit(1).select(scalars.mask_tokens(F.lit('executed cmd "rm x" now'), scalars.HOST_MASKS)).first()[0] == "executed cmd <:CMD:> now"


def test_small_functions(spark):
    one = spark.range(1)
    values = [scalars.bucket(F.lit(-1), 30), scalars.canonical_feature(F.lit("docker_cpu_core_12_pct")), scalars.reduce_mode(F.lit("Peak_bytes")), scalars.reduce_mode(F.lit("rx_bytes")), scalars.reduce_mode(F.lit("load"))]
    assert list(one.select(*(v.alias(f"c{i}") for i, v in enumerate(values))).first()) == [-30, "docker_cpu_core_X_pct", "max", "sum", "mean"]
    assert one.select(scalars.epoch_ms(F.lit("2021-07-01 00:00:00"))).first()[0] == 1625068800000
    assert one.select(scalars.finite(F.lit("x")), scalars.finite(F.lit("1.5")), scalars.finite(F.lit(float("nan")))).first()[:] == (None, 1.5, None)
    assert one.select(scalars.fit_vector(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 2)).first()[0] == [1.0, 2.0]


def test_c2_nested_traces(spark):
    def span(host, *children, start="s", stop="e"):
        info = {"host": host, "name": f"n-{host}"}
        info |= {"x-start": {"timestamp": start}} if start else {}
        info |= {"x-stop": {"timestamp": stop}} if stop else {}
        return {"trace_id": f"id-{host}", "parent_id": "p", "info": info, "children": list(children)}

    deep = {"trace_id": "root", "children": [span("a", span("b", span("c", stop=None)), span("d", start=None)), span("e")]}
    texts = [json.dumps(deep), json.dumps({"children": []}), "broken {", json.dumps([1]), None, json.dumps({"trace_id": 7, "children": [{"info": {"name": "x"}, "children": [span("g")]}, 5]})]
    frame = spark.createDataFrame([(t, f"f{i}", i) for i, t in enumerate(texts)], "body string, stem string, size int")
    spans, rejects = joins.split_traces(frame)
    got = spans.orderBy("stem", "position").collect()
    assert [(r["stem"], r["trace_id"], r["span_id"], r["host"], r["parent_host"], r["start"], r["stop"], r["position"]) for r in got] == [
        ("f0", "root", "id-a", "a", "start", "s", "e", 0), ("f0", "root", "id-b", "b", "a", "s", "e", 1), ("f0", "root", "id-c", "c", "b", "s", None, 2), ("f0", "root", "id-e", "e", "start", "s", "e", 4),
        ("f5", "7", "id-g", "g", None, "s", "e", 1),
    ]
    assert sorted((r["stem"], r["size"], r["host"], r["position"], r["reason"]) for r in rejects.collect() if r["host"]) == [("f0", 0, "d", 3, "no start")]
    assert sorted((r["stem"], r["reason"]) for r in rejects.collect() if not r["host"]) == [("f2", "unparsable"), ("f3", "unparsable"), ("f4", "unparsable"), ("f5", "no host"), ("f5", "no host")]
    assert {r["parentspan_id"] for r in got} == {"p"} and joins.flatten_traces(frame.limit(0)).count() == 0


def test_c2_traces_of_any_depth_in_one_scan(spark, tmp_path):
    deep = {"trace_id": "leaf", "info": {"host": "h0", "a-start": {"timestamp": "0"}}}
    for i in range(1, 100):
        deep = {"trace_id": f"t{i}", "info": {"host": f"h{i}", "a-start": {"timestamp": str(i)}}, "children": [deep]}
    (tmp_path / "x.json").write_text(json.dumps({"trace_id": "root", "children": [deep]}))
    spans = joins.flatten_traces(files.read_trace_json(spark, str(tmp_path)))
    assert [(r["host"], r["parent_host"]) for r in spans.orderBy("position").collect()] == [(f"h{99 - i}", f"h{100 - i}" if i else "start") for i in range(100)]
    assert spans._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_e1c_ends_are_filled_over_traces_in_file_order(spark):
    rows = [("f2", 1, None), ("f1", 0, None), ("f1", 1, "a"), ("f1", 2, None), ("f2", 0, None), ("f3", 0, "b")]
    frame = spark.createDataFrame(rows, "stem string, position long, stop string")
    filled = series.ffill(frame, [], ["stem", "position"], "stop", None, blocks=3)
    assert sorted(map(tuple, filled.collect())) == sorted([("f1", 0, None), ("f1", 1, "a"), ("f1", 2, "a"), ("f2", 0, "a"), ("f2", 1, "a"), ("f3", 0, "b")], key=lambda r: r[:2])


def test_c4_smallest_ip_wins(spark):
    metrics = spark.createDataFrame([(1, "system", "10.0.0.10", "cpu", 5.0), (1, "system", "10.0.0.9", "cpu", 7.0), (1, "system", "10.0.0.10", "mem", 3.0), (1, "a", "10.0.0.9", "own", 1.0)], "ts_ms long, service string, ip string, feature string, value double")
    ips = spark.createDataFrame([("10.0.0.10", "a"), ("10.0.0.9", "a"), ("10.0.0.10", "b"), ("10.0.0.10", "b")], "ip string, service string")
    got = sorted((r["service"], r["feature"], r["value"]) for r in joins.fan_out(metrics, ips).collect())
    assert got == [("a", "host_cpu", 7.0), ("a", "host_mem", 3.0), ("a", "own", 1.0), ("b", "host_cpu", 5.0), ("b", "host_mem", 3.0)]


def test_c9_codes_follow_the_order_of_the_text(spark):
    names = ["", "a", "aaaaaaaa", "aaaaaaab", "aaaaaaac", "b", "z", "é", "日本"]
    frame = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "name string")
    assert [r["name"] for r in joins.dictionary_of(frame, "name").orderBy("code").collect()] == names
    assert [r["code"] for r in joins.dictionary_of(frame, "name").orderBy("code").collect()] == list(range(len(names)))


def test_running_totals_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.randint(0, 9), rng.random() * 100]) * 1.0) for k in ["a"] * 300 + ["b"] * 41 + [None] * 7] + [("c", 5.0), ("d", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    counted = ranks.counts_of(frame, "v", ("k",))
    for ranges in (2, 5, 64):
        for r in ranks.with_running_totals(counted, F.col("v"), ["n"], ("k",), ranges=ranges).collect():
            assert r["n_before"] == sum(k == r["k"] and v is not None and v < r["v"] for k, v in rows)
    got = {r["k"]: r["q"] for r in ranks.quantiles(counted, "v", [0.05, 0.5, 0.95], ("k",)).collect()}
    disc = {r["k"]: r["q"] for r in ranks.quantiles(counted, "v", [0.5, 0.0, 1.0], ("k",), discrete=True).collect()}
    for k in ("a", "b", "c", None):
        values = sorted(v for x, v in rows if x == k)
        assert got[k] == pytest.approx(np.quantile(values, [0.05, 0.5, 0.95]))
        assert disc[k] == [values[(len(values) + 1) // 2 - 1], values[0], values[-1]]
    assert "d" not in got
    assert ranks.quantiles(ranks.counts_of(frame.limit(0), "v"), "v", [0.5]).first()["q"] == [None]


def test_c3_edges_of_cells(spark):
    rows = [(0, "a", "[x]", 5, 25), (1, "a", "[x]", 30, 60), (2, "b", "[y]", 50, 40), (3, "a", "[normal]", 5, 9), (4, "a", "[y]", 8, 9), (5, "a", "[x]", 1, None), (6, "zz", "[x]", 1, 2)]
    events = spark.createDataFrame(rows, "idx long, service string, anomaly_type string, st_ms long, ed_ms long")
    cells = joins.intervals_to_grid(events, 30, ["a", "b"])
    assert sorted((r["bucket_ms"], r["idx"]) for r in cells.collect()) == [(0, 0), (0, 4), (30, 1), (60, 1)]
    assert {(r["bucket_ms"], tuple(r["types"])) for r in aggregates.labels_by_cell(cells).collect()} == {(0, ("[x]", "[y]")), (30, ("[x]",)), (60, ("[x]",))}
    long = spark.createDataFrame([(0, "a", "[x]", 5, 30 * 1000 + 7), (1, "a", "[x]", 5, 30 * 6 - 1)], "idx long, service string, anomaly_type string, st_ms long, ed_ms long")
    for chunk in (1, 3, 7, 10_000):
        got = sorted((r["idx"], r["bucket_ms"]) for r in joins.intervals_to_grid(long, 30, chunk=chunk).collect())
        assert got == [(0, 30 * i) for i in range(1001)] + [(1, 30 * i) for i in range(6)]


def test_d6_every_branch(spark):
    groups = {"a_total": [0.0, 0.0], "b": [0.0, 5.0, 0.0], "c_total": [1.0, 2.0, 0.0], "c_max": [1.0, 2.0], "c": [1.0, 2.0, 0.0], "d": [float("nan"), 4.0], "e": [float("inf")]}
    rows = [(1, "s", f, v) for f, vs in groups.items() for v in vs]
    got = aggregates.reduce_duplicates(spark.createDataFrame(rows, "ts_ms long, service string, feature string, value double")).collect()
    assert {r["feature"]: r["value"] for r in got} == {"a_total": 0.0, "b": 5.0, "c_total": 3.0, "c_max": 2.0, "c": 1.5, "d": 4.0, "e": None}


def test_e1_limit_and_e3_gaps(spark):
    rows = [("k", i, 7.0 if i == 1 else None) for i in range(14)]
    got = [r["v"] for r in series.ffill(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"], "v", 10).orderBy("i").collect()]
    assert got == [None] + [7.0] * 11 + [None, None]
    grid = spark.createDataFrame([(t,) for t in (0, 30, 120, 240)], "bucket_ms long")
    assert [r["segment"] for r in series.segments(grid, step=30).orderBy("bucket_ms").collect()] == [0, 0, 0, 1]


def test_e5_masks_nothing_early(spark):
    labels = spark.createDataFrame([("s", i, 0) for i in range(40)], "service string, bucket_ms long, y int")
    for percent, hidden in ((0.0, 30), (0.5, 15), (1.0, 0)):
        got = series.mask_labels(labels, percent=percent).orderBy("bucket_ms").collect()
        assert sum(r["y_seen"] == 2 for r in got) == hidden and all(r["y_seen"] == 0 for r in got[:10])


def test_g2_resume_and_greedy(spark):
    lines = [(1, "open file a.txt ok"), (2, "open file b.txt ok"), (3, "open file was never seen here"), (4, "close it"), (5, "open file c.txt ok")]
    frame = spark.createDataFrame(lines, "line_id long, payload string")
    mined = templates.mine_greedy(frame, 0.5)
    assert {(" ".join(r["template"]), r["size"]) for r in mined.collect()} == {("open file <:*:> ok", 3), ("open file was never seen here", 1), ("close it", 1)}
    saved = templates.assign_ids(templates.mine_templates(frame.where("line_id < 3")))
    grown = templates.resume(frame, saved).collect()
    assert sorted((r["template_id"], " ".join(r["template"])) for r in grown) == [(1, "open file <:*:> ok"), (2, "open file was never seen here"), (3, "close it")]


@pytest.mark.parametrize("similarity,chunk", [(0.6, 7), (0.95, 10), (0.4, 3)])
def test_g2_no_group_is_larger_than_a_chunk(spark, similarity, chunk, monkeypatch):
    """Well-separated kinds of lines give the same templates for any chunk; where nothing can be merged it ends, in groups of a chunk at most."""
    draw = random.Random(4)
    rows = [(i, f"aaa bbb kind{k}x " + " ".join(f"{'abcdefgh'[(k + j) % 8] * 3}{'' if j < 6 else chr(97 + draw.randrange(26)) * 2}" for j in range(8))) for i, k in enumerate(draw.randrange(4) for _ in range(90))]
    frame = spark.createDataFrame([(i, p.replace("kind", "k").replace("0x", "zero").replace("1x", "one").replace("2x", "two").replace("3x", "three")) for i, p in rows], "line_id long, payload string")
    whole, cut = ({(" ".join(r["template"]), r["size"]) for r in templates.mine_greedy(frame, similarity, chunk=c).collect()} for c in (5000, chunk))
    assert sum(n for _, n in cut) == sum(n for _, n in whole) == 90
    assert cut == whole if similarity < 0.9 else len(cut) >= len(whole) > 20


def test_g4_templates_keep_their_ids_over_two_resumes(spark):
    lines = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "line_id long, payload string")
    row = lambda d: {r["template_id"]: (" ".join(r["template"]), r["version"]) for r in d.collect()}
    saved = templates.versioned(templates.assign_ids(templates.mine_templates(lines("open file alpha for reading", "close door now please thanks"))))
    assert row(saved) == {1: ("open file alpha for reading", 1), 2: ("close door now please thanks", 1)}
    once, log = templates.resume_versions(lines("open file beta for reading", "open file gamma for reading", "open file of quite others"), saved, 0.6)
    assert row(once) == {1: ("open file <:*:> for reading", 2), 2: ("close door now please thanks", 1), 3: ("open file of quite others", 1)}
    assert sorted((r["template_id"], r["version"]) for r in log.collect()) == [(1, 2), (3, 1)]
    twice, log = templates.resume_versions(lines("open file beta for writing", "close door now please thanks"), once, 0.6)
    assert row(twice) == {1: ("open file <:*:> for <:*:>", 3), 2: ("close door now please thanks", 1), 3: ("open file of quite others", 1)}
    again, log = templates.resume_versions(lines("open file beta for writing"), twice, 0.6)
    assert row(again) == row(twice) and log.count() == 0


@pytest.mark.parametrize(
    "profile,line,wanted",
    [
        (templates.SERVICE_PROFILE, "get http://a.b/c user_id=u1 uuid=xy-z&k|step->next_one", "get http://<:URL:> user id=<:USERID:> uuid=<:UUID:>&k step next one"),
        (templates.SERVICE_PROFILE, "a->b|c_d 10.0.0.1 0xff", "a b c d <:IP:> <:HEX:>"),
        (templates.HOST_PROFILE, 'executed cmd "rm x" a->b|c_d', "executed cmd <:CMD:> a->b|c d"),
    ],
)
def test_b7_profiles_of_masks_and_delimiters(spark, profile, line, wanted):
    assert spark.createDataFrame([(line,)], "p string").select(F.array_join(templates.tokenize(F.col("p"), **profile), " ")).first()[0] == wanted


def test_g2_chunks_of_a_leaf_are_merged(spark):
    rng = random.Random(1)
    lines = [(i, f"send part {rng.choice('abcdefgh')}{i} to peer now") for i in range(60)] + [(100 + i, f"send part x{i} was lost on way") for i in range(40)]
    lines = [(i, t if i < 100 else t.replace("part x", "part q")) for i, t in lines]
    frame = spark.createDataFrame(lines, "line_id long, payload string")
    whole, cut = ({(" ".join(r["template"]), r["size"], r["first"]) for r in templates.mine_greedy(frame, 0.6, chunk=chunk).collect()} for chunk in (5000, 7))
    assert whole == cut == {("send part <:*:> to peer now", 60, 0), ("send part <:*:> was lost on way", 40, 100)}


def test_h1b_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) @ np.array([[3.0, 1.0, 0.2], [0.0, 1.0, 0.5], [0.0, 0.0, 0.3]])
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    got = [r["energy"] for r in scoring.pca_energy(frame, ["a", "b", "c"]).orderBy("i").collect()]
    axes = np.linalg.eigh(np.cov(x.T))[1][:, -2:]
    centred = x - x.mean(0)
    assert got == pytest.approx(((centred - centred @ axes @ axes.T) ** 2).sum(1), abs=1e-9)


def test_h10_against_newton_steps(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(2 * x - 0.5)))).astype(int)
    rows = [(i, float(v), int(k)) for i, (v, k) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows + [(900, 5.0, 2)], "i int, energy double, y_seen int")
    got = [r["p_cls"] for r in scoring.residual_classifier(frame, frame.where("i < 900"), ["energy"]).orderBy("i").collect()]
    beta, design = np.zeros(2), np.column_stack([np.ones(200), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design.T * (p * (1 - p))) @ design, design.T @ (y - p))
    assert got == pytest.approx(1 / (1 + np.exp(-design @ beta)), abs=1e-3)


def test_scaling_fitted_on_the_first_part(spark):
    points = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 10.0), ("s", 3, 20.0)], "service string, at int, value double")
    assert [r["value"] for r in aggregates.min_max(points, ["service"], fit_on=F.col("at") < 3).orderBy("at").collect()] == [0.0, 1.0, 2.0]
    stats = spark.createDataFrame([("a", "b", "OK", 1, 4.0), ("a", "b", "OK", 9, 8.0)], "src string, dst string, status_code string, at int, duration_sum double")
    got = aggregates.scale_by_mean(stats, 2, factor=1, fit_on=F.col("at") < 5).orderBy("at").collect()
    assert [r["scaled"] for r in got] == pytest.approx([2.0, 4.0], abs=1e-5)
    counts = spark.createDataFrame([(0, "h", "t1", 4), (1, "h", "t1", 8), (1, "h", "t2", 2)], "bucket_ms long, service string, template_id string, n long")
    full = {(r["bucket_ms"], r["template_id"]): r["scaled"] for r in aggregates.scale_counts(counts, ["template_id"], mode="buckets", n_grid=2).collect()}
    short = {(r["bucket_ms"], r["template_id"]): r["scaled"] for r in aggregates.scale_counts(counts, ["template_id"], mode="buckets", n_grid=3).collect()}
    assert full == pytest.approx({(0, "t1"): 3 / 7, (1, "t1"): 1.0, (1, "t2"): 1.0}, abs=1e-5)
    assert short == pytest.approx({(0, "t1"): 0.5, (1, "t1"): 1.0, (1, "t2"): 1.0}, abs=1e-5)


def test_e1c_missing_ends_come_from_the_span_before(spark):
    spans = spark.createDataFrame([("f1", "000000", "5"), ("f1", "000001", None), ("f1", "000001.000000", None), ("f2", "000000", None), ("f2", "000001", "9")], "stem string, position string, stop string")
    got = series.ffill(spans, ["stem"], ["position"], "stop", None).orderBy("stem", "position").collect()
    assert [r["stop"] for r in got] == ["5", "5", "5", None, "9"]


def test_streaming_edges(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(seconds=10 * i), "a", f"b{i % 2}", "OK", float(i)) for i in range(30)] + [(at + datetime.timedelta(hours=1), "z", "z", "OK", 0.0)]
    spark.createDataFrame(rows, "ts timestamp, src string, dst string, status_code string, duration_s double").write.parquet(f"file://{tmp_path}/in")
    rolled = rollups.edge_rollup(rollups.read_stream(spark, f"file://{tmp_path}/in"))
    rollups.write_stream(rolled, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").where("src = 'a'").groupBy("dst").agg(F.sum("n"), F.sum("duration_sum")).orderBy("dst").collect()
    assert [tuple(r) for r in got] == [("b0", 15, 210.0), ("b1", 15, 225.0)]


def test_h_edges(spark):
    none = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.3)], "y int, yhat int, s double")
    assert scoring.prf(none, "y", "yhat").select("precision", "recall", "f1").first()[:] == (0.0, 0.0, 1.0)
    assert scoring.roc_auc(none, "y", "s").first()["auc"] is None
    tied = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.5), (1, 0, 0.5), (0, 0, 0.5)], "y int, yhat int, s double")
    assert scoring.roc_auc(tied, "y", "s").first()["auc"] == 0.5 and scoring.average_precision(tied, "y", "s").first()["ap"] == 0.5
    same = spark.createDataFrame([(1.0,)] * 4, "e double")
    assert {r["prob"] for r in scoring.robust_prob(same, "e").collect()} == {0.5}
    even = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "e double")
    assert [r["prob"] for r in scoring.robust_prob(even, "e").where("e = 2.0").collect()] == [0.5]


def test_same_rows_however_partitioned(spark):
    points = spark.range(600).select((F.col("id") * 1000).alias("ts_ms"), F.concat(F.lit("s"), F.col("id") % 3).alias("service"), F.lit("f").alias("feature"), (F.col("id") % 17).cast("double").alias("value"))
    wanted = None
    for n in (1, 17):
        moved = points.repartition(n)
        got = [sorted(map(str, f(moved).collect())) for f in (lambda p: scoring.residual_energy(p), lambda p: aggregates.min_max(p, ["service", "feature"]), lambda p: series.windows(p, ["service"], "ts_ms", ["value"], segment=None))]
        assert wanted is None or got == wanted
        wanted = got


def test_streaming_rollup(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(seconds=7 * i), f"s{i % 2}", "ERROR" if i % 3 else "INFO") for i in range(60)] + [(at + datetime.timedelta(hours=1), "s0", "INFO")]
    spark.createDataFrame(rows, "ts timestamp, service string, level string").write.parquet(f"file://{tmp_path}/in")
    rolled = rollups.log_rollup(rollups.read_stream(spark, f"file://{tmp_path}/in"))
    rollups.write_stream(rolled, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.agg(F.sum("log_total")).first()[0] == 60 and got.where("level_error + level_info <> log_total").count() == 0
