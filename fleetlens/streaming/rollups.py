"""The tumbling aggregates of logs and edges over streams: the batch semantics, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import LEVELS


def log_rollup(lines: DataFrame, ts: str = "ts", width: str = "30 seconds", lateness: str = "10 minutes", levels: tuple[str, ...] = (*LEVELS, "UNKNOWN")) -> DataFrame:
    """Counts per (window, service): each level of the vocabulary and all lines. Rows later than ``lateness`` are left out."""
    windowed = lines.withWatermark(ts, lateness).groupBy(F.window(ts, width), "service")
    return windowed.agg(*(F.count_if(F.col("level") == v).alias(f"level_{v.lower()}") for v in levels), F.count("*").alias("log_total")).select(F.col("window.start").alias("start"), "service", *(f"level_{v.lower()}" for v in levels), "log_total")


def edge_rollup(edges: DataFrame, ts: str = "ts", width: str = "30 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Duration sum and mean and count per (window, src, dst, status)."""
    windowed = edges.withWatermark(ts, lateness).groupBy(F.window(ts, width), "src", "dst", "status_code")
    return windowed.agg(F.sum("duration_s").alias("duration_sum"), F.avg("duration_s").alias("duration_mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "src", "dst", "status_code", "duration_sum", "duration_mean", "n")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows as Parquet, exactly once by the checkpoint; ends when what is there is read."""
    return df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
