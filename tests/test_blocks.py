"""Series in blocks give what plain windows over whole series give, for blocks of any size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import joins, ranks, scoring, series

def by():
    return Window.partitionBy("k").orderBy("t", "i")


@pytest.fixture(scope="module")
def points(spark):
    draw = random.Random(5)
    rows = [(k, draw.randrange(0, 60), i, None if draw.random() < 0.4 else draw.random()) for k, n in (("a", 90), ("b", 7), (None, 12), ("c", 1)) for i in range(n)]
    rows += [("hot", 5, i, None if i % 4 else float(i)) for i in range(40)]  # all at one time
    return spark.createDataFrame(rows, "k string, t long, i long, v double").cache()


def same(got, wanted):
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


@pytest.mark.parametrize("blocks", [2, 5, 50])
@pytest.mark.parametrize("limit", [1, 3, None])
def test_fill(points, blocks, limit):
    frame = by().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    same(series.ffill(points, ["k"], ["t", "i"], "v", limit, blocks), points.withColumn("v", F.last("v", ignorenulls=True).over(frame)))


@pytest.mark.parametrize("blocks", [2, 50])
def test_shift(points, blocks):
    same(series.shift(points, ["k"], ["t", "i"], "v", blocks), points.withColumn("v", F.lag("v", 1, 0).over(by())))


@pytest.mark.parametrize("blocks,w,stride", [(2, 4, 1), (50, 4, 1), (50, 4, 3), (7, 1, 1), (50, 10, 2)])
def test_windows(points, blocks, w, stride):
    placed = points.withColumn("at", F.struct("t", "i"))
    n = F.row_number().over(Window.partitionBy("k").orderBy("at"))
    steps = F.collect_list(F.struct("v")).over(Window.partitionBy("k").orderBy("at").rowsBetween(1 - w, 0))
    wanted = placed.withColumns({"n": n, "steps": steps}).where(f"n >= {w} and (n - {w}) % {stride} = 0").select("k", F.col("at").alias("end_ts"), "steps")
    same(series.windows(placed, ["k"], "at", ["v"], w, stride, None, blocks), wanted)


@pytest.mark.parametrize("blocks", [2, 50])
def test_energy(points, blocks):
    once = points.withColumn("t", F.col("t") * 1000 + F.col("i")).withColumn("f", F.lit("f")).fillna(0.5, ["v"]).where("k is not null")
    ahead = Window.partitionBy("k", "f").orderBy("t").rowsBetween(-3, -1)
    wanted = once.withColumns({"e": F.pow(F.col("v") - F.avg("v").over(ahead), F.lit(2.0)), "n": F.count("*").over(ahead)}).where("n = 3").groupBy("k", "t").agg(F.round(F.sum("e"), 9).alias("energy"))
    got = scoring.residual_energy(once, 4, "k", "f", "t", "v", blocks).withColumn("energy", F.round("energy", 9))
    same(got, wanted)


def test_label_masks(points):
    labels = points.select(F.col("k").alias("service"), (F.col("t") * 1000 + F.col("i")).alias("bucket_ms"), (F.col("i") % 3 == 0).cast("int").alias("y"))
    ordered = Window.partitionBy("service").orderBy("bucket_ms")
    wanted = labels.withColumn("late", F.row_number().over(ordered) > 10).withColumn("n", F.count_if("late").over(Window.partitionBy("service", "y").orderBy("bucket_ms")))
    wanted = wanted.withColumn("y_seen", F.when(F.col("late") & (F.col("n") % 10 >= 5), 2).otherwise(F.col("y"))).drop("late", "n")
    same(series.mask_labels(labels), wanted)


def test_no_window_holds_a_whole_series(points):
    for frame in (series.ffill(points, ["k"], ["t", "i"], "v", None), series.shift(points, ["k"], ["t", "i"], "v")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "_b" in plan.split("hashpartitioning(k", 1)[1][:30]


def test_gaps_and_missing_steps_of_a_long_span(spark):
    frame = spark.createDataFrame([("a", 0, 1.0), ("a", 25_003, 2.0), ("b", 7, 3.0)], "k string, t long, v double")
    filled = series.fill_gaps(frame, ["k"], "t", 1)
    assert filled.count() == 25_005 and filled.where("v is not null").count() == 3 and filled.select("k", "t").distinct().count() == 25_005
    missing = series.missing_steps(frame, "t", 1)
    assert missing.count() == 25_001 and missing.agg(F.min("t"), F.max("t")).first() == (1, 25_002)
    assert series.missing_steps(frame.limit(0), "t", 1).count() == 0


def test_like_named_values_fall_into_several_ranges(spark):
    names = spark.range(3000).select(F.format_string("service%04d", "id").alias("name"))
    counts = [r["count"] for r in ranks.in_ranges(names, F.col("name"), 8).groupBy("_r").count().collect()]
    assert len(counts) == 8 and max(counts) < 1000
    coded = {r["name"]: r["code"] for r in joins.dictionary_of(names.union(names), "name").collect()}
    assert coded == {f"service{i:04d}": i for i in range(3000)}


@pytest.mark.parametrize("ranges", [2, 3, 16, 100])
def test_ranges_are_in_order_and_even(spark, ranges):
    frame = ranks.in_ranges(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), F.col("v"), ranges)
    rows = sorted((r["v"], r["_r"]) for r in frame.collect())
    places = [r for _, r in rows]
    assert places == sorted(places) and len(set(places)) == ranges
    assert max(places.count(r) for r in set(places)) < 4 * 1000 / ranges + 20


def test_rows_are_numbered_within_keys(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "z"), (None, "z"), (None, "y")], "k string, v string")
    assert sorted(map(tuple, ranks.numbered(frame, ("v",), "n", 1, ("k",)).collect()), key=repr) == [("a", "w", 1), ("a", "x", 2), ("b", "z", 1), (None, "y", 1), (None, "z", 2)]
    assert ranks.numbered(frame.limit(0), ("v",), "n").count() == 0


@pytest.mark.parametrize("most", [10, 300, 100_000])
def test_quantiles_from_brackets(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "MOST_VALUES", most)
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    draw = random.Random(2)
    values = [draw.choice([draw.gauss(0, 1), 0.25, -3.0]) for _ in range(4001)] + [None] * 9
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    shares = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
    wanted = [known[max(1, -(-int(s * 4001 * 1000) // 1000)) - 1] for s in shares]
    assert ranks.exact_quantiles(frame, F.col("v"), shares) == wanted
    assert ranks.exact_quantiles(frame.where("v is null"), F.col("v"), shares) == [None] * 6
