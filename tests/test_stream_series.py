"""Streams over series give the rows of the batch operators on the same files, with a restart between."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import series as batch
from fleetlens.streaming import rollups, series

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def parts():
    """Rows of two services in two parts, out of order within ten minutes, with gaps and without values at times."""
    draw, rows = random.Random(8), []
    minute = {"a": 0, "b": 3}
    for _ in range(60):
        for service in minute:
            minute[service] += draw.choice([1, 1, 1, 2, 9])
            rows.append((service, START + datetime.timedelta(minutes=minute[service]), None if draw.random() < 0.4 else draw.random()))
    rows.sort(key=lambda r: r[1])
    last = max(r[1] for r in rows)
    rows += [("end", last + datetime.timedelta(days=1), 0.0)]  # what moves the watermark past all others
    half = len(rows) // 2
    out = []
    for part in (rows[:half], rows[half:]):
        files = [part[i : i + 10] for i in range(0, len(part), 10)]
        for one in files:
            draw.shuffle(one)
        out.append(files)
    return out


SCHEMA = "service string, ts timestamp, value double"
MINUTE = 60_000


def by():
    return Window.partitionBy("service").orderBy("ts")


def segmented(frame):
    gap = (F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(by())) > 3 * MINUTE).cast("long")
    return frame.withColumn("segment", F.coalesce(F.sum(gap).over(by()), F.lit(0).cast("long")))


def windowed(frame):
    got = batch.windows(segmented(frame), ["service"], "ts", ["value"], 4)
    return got.select("service", F.col("end_ts").alias("ts"), "segment", F.transform("steps", lambda s: s["value"]).alias("steps"))


CASES = {
    "fill": (lambda s: series.fill(s, 2, lateness="0 seconds"), lambda f: batch.ffill(f, ["service"], ["ts"], "value", 2)),
    "fill_unbounded": (lambda s: series.fill(s, None, lateness="0 seconds"), lambda f: batch.ffill(f, ["service"], ["ts"], "value", None)),
    "segments": (lambda s: series.segments(s, MINUTE, lateness="0 seconds"), lambda f: segmented(f).select("service", "ts", "segment")),
    "windows": (lambda s: series.windows(s, 4, MINUTE, lateness="0 seconds"), windowed),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_stream_is_batch(spark, tmp_path, parts, case):
    stream, plain = CASES[case]
    source, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    for files in parts:  # the second part arrives after a restart
        for one in files:
            spark.createDataFrame(one, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        rollups.write_stream(stream(rollups.read_stream(spark, source, 1000)), out, checkpoint).awaitTermination(200)
    every = spark.read.schema(SCHEMA).parquet(source)
    wanted, got = plain(every).where("service <> 'end'"), spark.read.parquet(out).where("service <> 'end'")
    assert sorted(map(repr, got.select(*wanted.columns).collect())) == sorted(map(repr, wanted.collect()))
    assert got.count() > 20
