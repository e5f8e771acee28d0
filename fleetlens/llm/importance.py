"""Importance resampling towards a target distribution, over hashed n-grams.

Features are runs of one to three words, hashed into buckets by CRC-32. A bucket's gain is the logarithm of how much
likelier the target's texts show it than the documents do; a document's weight is the sum of its features'
gains, and Gumbel noise on top of it turns taking the largest scores into drawing without replacement.

A batch of texts is joined into one byte string with a separator after each text, one pass of a regular expression finds all words,
and a binary search of the texts' offsets tells each word's text; n-grams whose first and last
word are of different texts are masked before they are counted. CRCs of n-grams are put together from those of
their words, which is linear algebra over bits, so no n-gram is ever spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, mixing

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, 5, 42
#: Words that a task handles at a time, within a text too
CHUNK_WORDS = 100_000
#: Bytes >= 0x80 are parts of characters beyond ASCII, all of which are parts of words
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words up to so many bytes have a table of their length
TABLES = 64


@cache
def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k with value b of a CRC becomes when n more bytes, all zero, are read."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    tables = np.empty((TABLES + 1, 4, 256), np.uint32)
    tables[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(TABLES):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ step[tables[n] & np.uint32(0xFF)]
    return tables


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    tables = _shift_tables()
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= tables[n, k, (crc >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together from two parts: the parts' own, and the bytes of the second."""
    out, left = first, size.copy()
    while (left > TABLES).any():
        out = np.where(left > TABLES, _moved(out, np.minimum(left, TABLES)), out)
        left = np.where(left > TABLES, left - TABLES, left)
    return _moved(out, left) ^ second


SPACE_CRC = np.uint32(crc32(b" "))


def ngrams(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts' numbers, buckets) of all n-grams of a batch, some at a time; and for n = 1 first, so that words can be counted.

    Each yields the n-grams that end in one chunk of words, by length from 1 to ``longest``.
    """
    parts = [(t or "").encode().lower() for t in texts.to_pylist()]
    edges = np.cumsum([0, *(len(p) + 1 for p in parts)])
    found = WORD.finditer(SEPARATOR.join(parts))
    tail: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, np.uint32, np.int64))]
    del parts
    while words := [(m.start(), m[0]) for m in islice(found, CHUNK_WORDS)]:
        starts = np.fromiter((s for s, _ in words), np.int64, len(words))
        own = np.fromiter((crc32(w) for _, w in words), np.uint32, len(words))
        sizes = np.fromiter((len(w) for _, w in words), np.int64, len(words))
        owner, own, sizes = (np.concatenate(x) for x in zip(tail[0], (np.searchsorted(edges, starts, side="right") - 1, own, sizes)))
        old = len(owner) - len(words)
        spaced = joined_crc(np.full(len(own), SPACE_CRC), own, sizes)
        crc = own
        for n in range(1, longest + 1):
            if n > 1:  # a run of n words ends at word i: that of n - 1 before it, a space and the word
                crc = joined_crc(crc[:-1], spaced[n - 1 :], sizes[n - 1 :] + 1) if len(own) >= n else crc[:0]
            last = np.arange(n - 1, len(own))
            inside = (last >= old) & (owner[n - 1 :] == owner[: len(own) - n + 1]) if len(own) >= n else np.zeros(0, bool)
            yield owner[n - 1 :][inside], (crc[inside] % np.uint32(buckets)).astype(np.int64)
        keep = slice(max(0, len(own) - longest + 1), None)
        tail = [(owner[keep], own[keep], sizes[keep])]


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket that has any. Each task counts its own first."""
    common.bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.slices(batch, batch.column(0)):
                for _, hits in ngrams(part.column(0), buckets, longest):
                    total += np.bincount(hits, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from counts of the documents and of the target, each with one more in every bucket."""
    every = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("_s"), F.sum("t").alias("_t"))
    d = lambda c, more: F.col(c).cast("double") + float(more)
    ratio = (d("t", 1) * d("_s", buckets)) / (d("s", 1) * d("_t", buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row


def with_weights(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Add n_words, n_features and weight; the text goes. ``gains`` has a number for each bucket and goes to every task."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def compute(texts: pa.Array) -> list[pa.Array]:
            n, sums = len(texts), [np.zeros(len(texts), np.int64) for _ in range(3)]
            for k, (owner, hits) in enumerate(ngrams(texts, len(gains), longest)):
                counted = np.bincount(owner, minlength=n)
                sums[0] += counted if k % longest == 0 else 0
                sums[1] += counted
                first = np.flatnonzero(np.diff(owner, prepend=-1))  # texts stand in a row
                if len(first):
                    sums[2][owner[first]] += np.add.reduceat(gains[hits], first)
            return [pa.array(x) for x in sums]

        return compute

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return common.with_batch_columns(docs, "text", fields, make, drop=("text",))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The noise of a document, in thousandths: a function of its id and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    uniform = (F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document: rank from 1 for the ``share`` percent drawn, null for others.

    ``docs`` has doc_id and text, ``target`` text; other columns are not read. Only documents of at least ``least_words`` words
    take part in the draw. A null or empty text has no features and weight 0. Rows that repeat an id are
    documents of their own, with the same noise; ties go to the smaller id (null last), then to the smaller weight and fewer features. A
    null id has the noise of an empty one. Without a target's features all gains follow from the documents'
    counts; without documents there is no row. Texts of any length are read in chunks of words.
    """
    docs = docs.select("doc_id", "text")
    gains = bucket_gains(bucket_counts(docs, "text", buckets, longest), bucket_counts(target, "text", buckets, longest), buckets)
    table = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():  # as many rows as buckets
        table[bucket] = gain
    weighed = with_weights(docs, table, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    weighed = common.materialize(weighed.withColumns({"_out": F.col("n_words") < least_words, "_one": F.lit(1)}), "weighed")
    drawn = weighed.where("not _out").count() * share // 100
    order = [F.col("_out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_features")]
    ranked = mixing.with_running_sum(weighed, order, "_one", "_ahead")
    rank = F.when(~F.col("_out") & (F.col("_ahead") < drawn), F.col("_ahead") + 1).cast("long")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, its score and its rank in the draw."""
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The same in SQL; CRC-32 byte by byte, over distinct n-grams."""
    table = []
    for byte in range(256):
        value = byte
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(str(value))
    lower = f"translate(coalesce(text, ''), '{ALPHABET}', '{ALPHABET.lower()}')"
    words = f"list_filter(string_split_regex({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    grams = lambda of: f"SELECT {of}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram"
    return f"""
WITH crc_table AS (SELECT [{', '.join(table)}]::UBIGINT[] AS t),
docs AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
target AS (SELECT {words} AS w FROM benchmark),
doc_grams AS (SELECT k, gram, count(*) AS n FROM ({grams('k')} FROM docs) GROUP BY ALL),
target_grams AS (SELECT gram, count(*) AS n FROM ({grams('1 AS one')} FROM target) GROUP BY gram),
hashed AS (SELECT gram, CAST(xor(list_reduce(list_transform(range(length(hex(gram)) // 2), lambda i: CAST('0x' || substr(hex(gram), CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % {BUCKETS} AS BIGINT) AS bucket
  FROM (SELECT gram FROM doc_grams UNION SELECT gram FROM target_grams), crc_table),
s AS (SELECT bucket, sum(n) AS n FROM doc_grams JOIN hashed USING (gram) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM target_grams JOIN hashed USING (gram) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS all_s, coalesce((SELECT sum(n) FROM t), 0) AS all_t),
gains AS (SELECT b AS bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(all_s + {BUCKETS} AS DOUBLE)) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(all_t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b, totals),
weights AS (SELECT k, sum(n) AS n, sum(n * gain) AS weight FROM doc_grams JOIN hashed USING (gram) JOIN gains USING (bucket) GROUP BY k),
scored AS (SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (k)),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS r FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN r <= {SHARE} * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (k)
"""
