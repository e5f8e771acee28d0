"""What grew faster than the input: files a trace, rows a token, groups a leaf, rows a batch."""

import glob
import re

from pyspark.sql import functions as F

from fleetlens import catalog, storage
from fleetlens.llm import mixing, vector_search
from fleetlens.operators import joins, ranks, templates
from fleetlens.sources import files

DATA = "/root/testdata/sf0.01"


def _shuffled(spark, run) -> int:
    """Bytes that ``run`` shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def _prose(spark, n=3000):
    """Lines of forty words that have little in common."""
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.translate(F.substring(F.sha2(F.concat_ws("/", "id", i), 256), 1, 7), "0123456789", "ghijklmnop"))
    lines = storage.stored(spark.range(n).select(F.col("id").alias("line_id"), F.array_join(words, " ").alias("payload")), "prose")
    return lines, lines.agg(F.sum(F.length("payload"))).first()[0]


def _files_of(monkeypatch, spark, name):
    """How many files with data the query's traces are read from."""
    made = []
    at = files.scratch
    monkeypatch.setattr(files, "scratch", lambda *a: made.append(at(*a)) or made[-1])
    rows = catalog.QUERIES[name](spark, DATA).count()
    paths = [p for m in made for p in glob.glob(m.removeprefix("file://") + "/**", recursive=True) if p.endswith((".json", ".txt", ".csv"))]
    return rows, len(paths)


def test_traces_are_read_from_a_bounded_number_of_files(spark, monkeypatch):
    traces = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
    for name in ("c02_trace_rejects", "a05_c02_flatten_traces", "l3_host_spans", "l3_host_graph", "e01c_span_ends"):
        rows, n = _files_of(monkeypatch, spark, name)
        assert rows and 0 < n <= max(8, traces // 4), name
        monkeypatch.undo()


def test_bundles_keep_any_text(spark, tmp_path):
    rows = [("a", '{"trace_id":"x",\n"children":[]}'), ("b", ""), ("c", None), (None, 'no "json" \\   é'), ("d", "[" * 50)]
    files.write_trace_bundles(spark.createDataFrame(rows, "stem string, body string"), f"{tmp_path}/traces")
    assert sorted(map(repr, ((r["stem"], r["body"]) for r in files.read_trace_bundles(spark, f"{tmp_path}/traces").collect()))) == sorted(map(repr, rows))


def test_a_walk_hands_on_spans_in_batches(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_ROWS", 7)
    body = lambda n: '{"trace_id":"t","children":[' + ",".join('{"info":{"host":"h%d","a-start":{"timestamp":"%d"}}}' % (i, i) for i in range(n)) + "]}"
    frame = spark.createDataFrame([(n, body(n)) for n in (0, 3, 20, 1, 14)], "stem long, body string").coalesce(1)
    sizes = frame.select("stem", "body").transform(joins.walk_traces)
    assert sorted((r["stem"], r["position"], r["host"]) for r in sizes.collect()) == sorted((n, i, f"h{i}") for n in (3, 20, 1, 14) for i in range(n))
    assert sizes.schema["stem"].dataType.simpleString() == "bigint"


def test_greedy_mining_starts_no_group_for_each_leaf(spark):
    lines, _ = _prose(spark, 500)
    plan = lambda: templates.mine_greedy(lines)
    seen = []
    stored = templates.stored
    try:
        templates.stored = lambda df, name: seen.append(df._jdf.queryExecution().toString()) or stored(df, name)
        assert plan().count() == 500
    finally:
        templates.stored = stored
    assert not any("FlatMapGroupsInPandas" in p for p in seen)


def test_greedy_clusters_of_a_large_leaf_are_those_of_lists(spark):
    import random

    draw = random.Random(4)
    shapes = [(" ".join(draw.choice("ab") if j < 3 else str(draw.randrange(4)) for j in range(8)), draw.randrange(1, 9), i) for i in range(300)]
    shapes = list({t: (t, n, i) for t, n, i in shapes}.values())
    found = []
    for text, n, first in shapes:
        tokens = text.split(" ")
        scores = [sum(a == b for a, b in zip(one[0], tokens) if a != templates.WILD) / len(tokens) for one in found]
        if scores and max(scores) >= 0.6:
            best = found[scores.index(max(scores))]
            best[0], best[1] = [a if a == b else templates.WILD for a, b in zip(best[0], tokens)], best[1] + n
        else:
            found.append([tokens, n, first])
    assert templates.greedy_clusters(shapes, 0.6) == [(" ".join(t), n, first) for t, n, first in found] and len(found) > 1


def test_mining_shuffles_no_more_than_the_text(spark):
    lines, size = _prose(spark)
    assert _shuffled(spark, lambda: templates.mine_templates(lines).write.format("noop").mode("overwrite").save()) < 1.5 * size


def test_what_a_task_holds_does_not_change_templates(spark, monkeypatch):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a b d", "a b c", "7 x", "q", None, "a b e", "q"])], "line_id long, payload string")
    want = sorted(map(str, templates.mine_templates(frame, masks=[]).collect()))
    monkeypatch.setattr(templates, "MOST_HELD", 1)
    assert sorted(map(str, templates.mine_templates(frame.coalesce(1), masks=[]).collect())) == want
    assert {(" ".join(r["template"]), r["size"], r["first"]) for r in templates.mine_templates(frame, masks=[]).collect()} == {("a b <:*:>", 4, 0), ("<:*:> x", 1, 3), ("q", 2, 4)}


def test_numbering_shuffles_no_more_than_the_text(spark):
    lines, size = _prose(spark)
    mined = storage.stored(templates.mine_templates(lines), "mined")
    assert _shuffled(spark, lambda: templates.assign_ids(mined).write.format("noop").mode("overwrite").save()) < 1.5 * size


def test_numbers_of_templates_with_odd_tokens(spark):
    rows = [(5, ["a b", "c"]), (5, ["a", "b"]), (5, []), (1, ["z"]), (9, None), (5, ["a", None])]
    got = templates.assign_ids(spark.createDataFrame(rows, "first long, template array<string>")).collect()
    assert [(r["first"], r["template"]) for r in sorted(got, key=lambda r: r["template_id"])][0] == (1, ["z"])
    assert sorted(map(repr, ((r["first"], r["template"]) for r in got))) == sorted(map(repr, rows)) and {r["template_id"] for r in got} == set(range(1, 7))


def test_ranges_by_beginnings_keep_the_order(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("first"), F.concat(F.lit("ab"), F.col("id").cast("string")).alias("text"))
    got = ranks.numbered(frame, ("first", "text"), "n", 1, dealt=("first", F.substring("text", 1, 3)))
    assert [r["n"] for r in got.orderBy("first", "text").collect()] == list(range(1, 501))


def test_matching_shuffles_no_more_than_lines_and_templates(spark):
    lines, size = _prose(spark)
    ids = storage.stored(templates.assign_ids(templates.mine_templates(lines)), "ids")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffled(spark, lambda: templates.match_templates(lines, ids).write.format("noop").mode("overwrite").save()) < 2.5 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_resuming_shuffles_a_few_times_the_text(spark):
    lines, size = _prose(spark)
    saved = storage.stored(templates.assign_ids(templates.mine_templates(lines.where("line_id % 2 = 0"))), "ids")
    assert _shuffled(spark, lambda: templates.resume(lines, saved).write.format("noop").mode("overwrite").save()) < 4 * size


def test_versions_shuffle_a_few_times_the_text(spark):
    lines, size = _prose(spark)
    saved = storage.stored(templates.versioned(templates.assign_ids(templates.mine_templates(lines.where("line_id % 2 = 0")))), "ids")
    assert _shuffled(spark, lambda: templates.resume_versions(lines, saved)[0].write.format("noop").mode("overwrite").save()) < 6 * size


def test_vectors_are_searched_in_bounded_steps(spark, monkeypatch):
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.pmod(F.hash("id", i), F.lit(1000)).cast("float")).alias("embedding"))
    want = sorted(map(str, vector_search.search(vectors).collect()))
    monkeypatch.setattr(vector_search, "STEP_ROWS", 1)
    monkeypatch.setattr(vector_search, "STEP_PAIRS", 50)
    assert sorted(map(str, vector_search.search(vectors).collect())) == want and len(want) == 15 * 20


def test_blocks_of_the_mix_are_not_broadcast(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[rank#\d+L, block#\d+L\]", plan) and not re.search(r"BroadcastHashJoin \[rank#\d+L, block#\d+L\]", plan)
