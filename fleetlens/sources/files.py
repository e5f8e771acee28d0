"""Sources and sinks: tolerant CSV, file metadata, traces, tables, incremental outputs and run results."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranks import numbered
from ..storage import scratch, stored


def read_tolerant_csv(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """A1. Rows of CSV files whose end may be cut off inside a quoted field; bad bytes are replaced.

    A file with an odd number of quotes loses its unterminated last record. Quotes are counted per file line
    by line; a file that spans lines within quotes is one split, so its last record has the highest row number.
    """
    quotes = spark.read.text(paths).select("_metadata.file_path", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("q")).groupBy("file_path").agg((F.sum("q") % 2).alias("odd"))
    rows = spark.read.csv(paths, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    last = rows.groupBy("_file").agg(F.max("_at").alias("_last"))
    cut = last.join(quotes, last["_file"] == quotes["file_path"]).where("odd = 1").select("_file", F.col("_last").alias("_at"))
    return rows.join(cut, ["_file", "_at"], "left_anti").drop("_file", "_at")


def cut_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A1. (file_path): the files that ``read_tolerant_csv`` shortens, for a quarantine table."""
    quotes = spark.read.text(paths).select("_metadata.file_path", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("q"))
    return quotes.groupBy("file_path").agg((F.sum("q") % 2).alias("odd")).where("odd = 1").select("file_path")


def read_entities(spark: SparkSession, root: str, pattern: str, entities: list[str], schema: StructType, **options) -> DataFrame:
    """A2. The files ``pattern`` (with {entity}) of each entity under ``root``, in one scan; absent files are skipped with a warning.

    ``absent_entities`` tells which they are.
    """
    absent = set(absent_entities(spark, root, pattern, entities))
    for entity in sorted(absent):
        warnings.warn(f"no file {pattern.format(entity=entity)} under {root}", stacklevel=2)
    there = [f"{root}/{pattern.format(entity=e)}" for e in entities if e not in absent]
    return spark.read.csv(there, schema=schema, header=True, multiLine=True, quote='"', escape='"', **options) if there else spark.createDataFrame([], schema)


def absent_entities(spark: SparkSession, root: str, pattern: str, entities: list[str]) -> list[str]:
    """A2. The entities that have no file, in their order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [e for e in entities if not system.globStatus(path(f"{root}/{pattern.format(entity=e)}"))]


def with_file_metadata(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """A3. Add the pattern's groups from each row's file name; rows of other files go. ``df`` must be a file scan."""
    file = F.col("_metadata.file_name")
    return df.select("*", *(F.regexp_extract(file, pattern, i + 1).alias(n) for i, n in enumerate(names))).where(F.col("_metadata.file_name").rlike(pattern))


#: <service>_<ip>_<feature>_<first day>_<last day>.csv
METRIC_FILE = r"^(\w+)_([\d.]+)_(.+)_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.csv$"


def read_metric_files(spark: SparkSession, root: str) -> DataFrame:
    """A3, A4. (ts_ms, value, service, ip, feature, first_day, last_day) of all metric files, two columns read."""
    scan = spark.read.csv(root, schema="timestamp long, value string", header=True, recursiveFileLookup=True)
    named = with_file_metadata(scan, METRIC_FILE, ["service", "ip", "feature", "first_day", "last_day"])
    return named.select(F.col("timestamp").alias("ts_ms"), F.col("value").try_cast("double").alias("value"), "service", "ip", "feature", "first_day", "last_day")


def host_of_file(df: DataFrame) -> DataFrame:
    """A3b. Add host and stem: the file name before its first _ and before its extension."""
    name = F.col("_metadata.file_name")
    return df.select("*", F.split_part(name, F.lit("_"), F.lit(1)).alias("host"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def read_columns(spark: SparkSession, path: str, cols: list[str], form: str = "parquet") -> DataFrame:
    """A4. A scan of some columns; the reader skips the others."""
    return spark.read.format(form).load(path).select(*cols)


def read_trace_json(spark: SparkSession, root: str) -> DataFrame:
    """A5. (body, stem) of every JSON trace file below ``root``."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("value").alias("body"), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("stem"))


def write_trace_bundles(traces: DataFrame, root: str) -> None:
    """A5, the reverse of ``read_trace_bundles``: traces (body, stem) as files of many lines, so that their number does not grow with that of traces."""
    traces.select("stem", "body").write.mode("overwrite").option("ignoreNullFields", False).json(root)


def read_trace_bundles(spark: SparkSession, root: str) -> DataFrame:
    """A5. (body, stem) of bundles of traces: a JSON line of each trace with its file's stem and its text, whatever that is.

    A file for each trace costs a listing, an opening and a task's split for some kilobytes, and the driver sees every name; bundles are split and read like any table.
    A line that is none gives a null body, which is no trace.
    """
    return spark.read.schema("stem string, body string").json(root).select("body", "stem")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet", mode: str = "overwrite") -> None:
    """A6, A7, A8. A table, a window data set or a graph as files, by partition if given; CSV has a header."""
    writer = df.write.mode(mode).format(form)
    if form == "csv":
        writer = writer.option("header", True).option("escape", "\"")  # quotes doubled, as the tolerant reader expects
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_named_files(df: DataFrame, root: str, name: str, form: str = "csv") -> None:
    """A6, the reverse of A3 and A5. One file below ``root`` for each value of ``name``, which is its file name, of the other columns."""
    spark = df.sparkSession
    write_table(df.repartition(name), f"{root}-parts", [name], form=form)
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(root))
    for part in system.globStatus(path(f"{root}-parts/{name}=*/part-*")):
        at = part.getPath()
        system.rename(at, path(f"{root}/{at.getParent().getName().split('=', 1)[1]}"))
    system.delete(path(f"{root}-parts"), True)


def read_windows(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """A7. Windows in the order of their number, the first few if wanted."""
    frame = spark.read.parquet(path)
    return frame.orderBy("window_id").limit(first) if first else frame.orderBy("window_id")


def number_windows(windows: DataFrame, order: list[str]) -> DataFrame:
    """A7. Add window_id from 0 in the order of the distinct window ends."""
    return windows.join(numbered(windows.select(*order).distinct(), tuple(order), "window_id"), order)


def materialize(spark: SparkSession, output: str, inputs: list[str], build: Callable[[], DataFrame], force: bool = False) -> bool:
    """A9. Build ``output`` if it is missing, forced, or older than any of the files in ``inputs``. True if built."""
    if not force and (made := _newest(spark, output)) is not None:
        changed = [t for t in (_newest(spark, i) for i in inputs) if t is not None]
        if not changed or max(changed) <= made:
            return False
    build().write.mode("overwrite").parquet(output)
    return True


def materialize_parts(
    spark: SparkSession, output: str, inputs: list[str], part_of: Callable[[Column], Column], build: Callable[[list[str]], DataFrame], part: str = "part"
) -> list[str]:
    """A9, by parts. Build only the partitions of ``output`` whose input files are new, changed or gone; the names of those, in order.

    ``part_of`` gives a file path's partition, and ``build`` gets the paths of the changed partitions' files and returns rows with
    the column ``part``. A manifest beside the output says which files, of which time and length, each partition was made of; it is replaced
    after the partitions, so a run that breaks off is made up for by the next. Partitions whose files are all gone are removed.
    """
    manifest, jvm = f"{output.rstrip('/')}-manifest", spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(output).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs).select("path", F.unix_millis("modificationTime").alias("modified"), "length")
    now = stored(found.withColumn("part", part_of(F.col("path")).cast("string")), "files")
    if system.exists(path(manifest)):
        before = spark.read.schema(now.schema).parquet(manifest)
        new, gone = now.join(before, now.columns, "left_anti"), before.join(now, now.columns, "left_anti")
        changed = new.select("part").union(gone.select("part")).distinct()
    else:
        changed = now.select("part").distinct()
    changed = stored(changed, "changed")
    names = [r[0] for r in changed.orderBy("part").collect()]  # one row a partition to be built
    if not names:
        return []
    sources = [r[0] for r in now.join(changed, "part", "left_semi").select("path").orderBy("path").collect()]  # the paths that the scan is given
    if sources:
        build(sources).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(output)
    kept = {r[0] for r in now.join(changed, "part", "left_semi").select("part").distinct().collect()}
    for name in set(names) - kept:
        system.delete(path(f"{output}/{part}={name}"), True)
    now.write.mode("overwrite").parquet(manifest)
    return names


def _newest(spark: SparkSession, path: str) -> int | None:
    """Milliseconds of the latest change of the files at ``path``; None without files."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    files, newest = system.listFiles(at, True), None
    while files.hasNext():
        newest = max(newest or 0, files.next().getModificationTime())
    return newest


def append_run(df: DataFrame, path: str) -> None:
    """A10. Append the row of a run (its parameters and metrics) to a table; new columns may appear later."""
    df.write.mode("append").option("mergeSchema", True).parquet(path)
