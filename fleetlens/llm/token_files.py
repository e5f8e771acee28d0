"""Token ids as Parquet files: list columns in doc_id order that can be read in part.

One row per document holds its id, its number of tokens and the list of ids. Ids repeat, so their column is
dictionary encoded (16 bits or less an id before compression); row groups and pages have set sizes, and
the writer adds page indexes, so a reader of few documents skips pages and a reader of lengths never
touches the ids.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

END_ID, ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 0, 32 << 20, 256 << 10, 2000
#: Bytes of text that go into a file, about: what one task sorts, encodes and writes, and sums again for the starts
FILE_BYTES = 256 << 20


def file_count(docs: DataFrame) -> int:
    """Files for the texts of ``docs``: one for each ``FILE_BYTES`` of them, and as many as the session has shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, files: int | None = None) -> None:
    """Write doc_id, n_tokens and token_ids of ``docs`` (doc_id, text) to ``folder``, in ascending doc_id order.

    Files follow one another by number, rows by position. A null doc_id comes first, and rows that repeat an
    id stand together, ordered by text. A null or empty text has the end id alone. Other columns are not
    written; an empty table leaves a folder without rows. The number of files grows with the bytes of all texts, which
    are counted first, unless ``files`` sets it.
    """
    files = files or file_count(docs)
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = bpe.encode(rows, path, end_id=end_id, drop=("text",)).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
    }
    encoded.write.options(**options).parquet(folder)


def read_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, file and row of each document: the id column stays unread."""
    return spark.read.parquet(folder).select("doc_id", "n_tokens", *_place())


def read_tokens(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """doc_id, n_tokens and token_ids of the documents from ``first`` to ``last``.

    Rows stand in doc_id order and the filter goes down to the scan, so files and row groups of other ids are left out by
    their statistics, and pages by the page index.
    """
    return spark.read.parquet(folder).select("doc_id", "n_tokens", "token_ids").where(F.col("doc_id").between(first, last))


def _place() -> list:
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return [file.alias("file"), F.col("_metadata.row_index").alias("row")]


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: summed within each file, after the totals of the files before."""
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    shift = totals.withColumn("_shift", F.coalesce(F.sum("_total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(shift), "file").withColumn("start", F.col("start") + F.col("_shift")).drop("_shift")


def with_checksums(rows: DataFrame, ids: str = "token_ids", drop: bool = True) -> DataFrame:
    """Add ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers; null ids count as none."""

    def make():
        def compute(lists: pa.Array) -> list[pa.Array]:
            raw, at = memoryview(lists.values.buffers()[1] or b"").cast("B"), lists.offsets.to_numpy() + lists.values.offset
            return [pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())]

        return compute

    return common.with_batch_columns(rows, ids, [T.StructField("ids_crc32", T.LongType())], make, (ids,) if drop else ())


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the files."""
    folder = common.new_folder(spark, "token-files")
    write_token_files(common.table(spark, sf_dir, "documents"), folder)
    stored = spark.read.parquet(folder).select("doc_id", "n_tokens", "token_ids", *_place())
    read = common.materialize(with_checksums(stored), "token-sums")  # small, and read twice for the starts
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
