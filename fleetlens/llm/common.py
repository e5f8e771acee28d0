"""What the operators of this package share: shared storage, column bookkeeping, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

#: Rows that Spark hands to a Python worker at once, where the session has no number of its own: rows here are whole texts.
BATCH_ROWS = 1000
#: Text bytes that one step of a Python worker holds at a time; a longer text is a step of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; it goes when the application ends."""
    return files.scratch(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage ends at files that every executor sees, so a lost executor costs no recomputation, and
    a later join reads plain scans whose skewed partitions Spark can split.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names compare as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def packed(df: DataFrame, *kept: str) -> DataFrame:
    """``df`` as the columns ``kept`` and one more, ``_row``, that holds all others, so that no name of theirs can clash."""
    others = [c for c in df.columns if c not in kept]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    return df.select(*kept, row.alias("_row"))


def unpacked(df: DataFrame, columns: list[str], *kept: str) -> DataFrame:
    """The reverse of ``packed``: ``columns`` in their order and nothing else."""
    return df.select(*[F.col(c) if c in kept else F.col("_row").getField(c).alias(c) for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of texts small on both sides of the pipe to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose values in ``column`` hold about ``most`` bytes."""
    if not len(batch):
        return
    per_row = max(1, column.nbytes // len(batch))
    at = 0
    while at < len(batch):
        n = max(1, most // per_row)
        while n > 1 and column.slice(at, n).nbytes > 2 * most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def with_batch_columns(
    df: DataFrame, source: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add columns that a Python function computes from one column, slice by slice.

    ``make`` runs once in each task and returns the function from the values of ``source`` to one array
    for each of ``fields``. Other columns pass through, but for ``drop`` and those with a new field's name.
    """
    bound_batches(df.sparkSession)
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, batch.column(source)):
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + compute(part.column(source)), names=names)

    return df.mapInArrow(run, T.StructType(kept + fields))


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; ``FLEETLENS_TOKENIZERS`` overrides the folder."""
    if folder := os.environ.get("FLEETLENS_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
