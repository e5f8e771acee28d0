"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Vectors are scaled into one ball and given one more dimension that brings all to the same length, so the
largest inner product is the smallest distance. They are dealt to the lists of the nearest centroids, and
rotated at random, so any few of their dimensions estimate a whole distance.

A query reads its nearest few lists whole, which gives it a bound: the distance of the last it would return
so far. In all its other lists the rotated dimensions are read in blocks, for all queries and vectors of a
chunk at once. After each block a test on the partial distances (could a whole distance within the bound show
so large a part?) abandons pairs, and only the rest read on. Survivors are scored exactly on the original
vectors in double precision.

Equal vectors are searched once: among them only the smallest ids can be among the nearest, and these are
put back at the end. Lists are cut into bounded chunks of vectors and of queries, so no task holds a whole
list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that centroids are fitted on at most (the smallest by a hash of the id), and the most centroids.
FIT_VECTORS, MOST_LISTS = 20_000, 1024
QUERY_EVERY, NEAREST = 20, 20
#: Dimensions read at a time, and how many standard deviations beyond the bound a partial distance must lie to be abandoned
BLOCK_DIMS, SLACK = 8, 2.0
#: The share of neighbours whose lists must be probed, as measured within the sample, and the queries of that measurement
AIM, AIM_QUERIES, LEAST_PROBED = 0.95, 256, 8
#: One in so many of the probed lists, the nearest ones, is read whole for the bound
BOUND_PART = 8
#: Vectors and queries of a list that are scanned together at most, and queries of them at a time
CHUNK_VECTORS, CHUNK_QUERIES, STEP_QUERIES = 4096, 512, 64
#: Rows of (query, list) that are handed on at a time, and pairs of vectors that are compared at a time
STEP_ROWS, STEP_PAIRS = 20_000, 1 << 16


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector as floats or doubles): rows whose vector is not null, not zero and holds finite numbers alone."""
    kind = table.schema[vector].dataType.simpleString()
    x = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.select(key, x.alias("vector")).where(F.col(key).isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Plain k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = nearest_lists(sample, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=lists)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def nearest_lists(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    distance = (centers**2).sum(1) - 2 * x @ centers.T
    if n == 1:
        return distance.argmin(1)[:, None]
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


def as_query(x: np.ndarray) -> np.ndarray:
    """A query has no part in the added dimension, so its distance to a lifted vector falls as their product grows."""
    none = np.finfo(float).tiny  # of a sample's vector nothing may be left
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), none)  # squares of the largest and smallest doubles would be infinite or zero
    return np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), none), np.zeros((len(x), 1))])


def lift(x: np.ndarray, scale: float, radius: float) -> np.ndarray:
    """Vectors of length 1: the given ones by ``scale`` and ``radius``, and what is lacking in one more dimension."""
    x = x / scale / radius
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))[:, None]])


def lists_to_probe(sample: np.ndarray, centers: np.ndarray, nearest: int, aim: float = AIM) -> int:
    """How many lists hold the share ``aim`` of the true neighbours of the sample's first vectors, within the sample.

    The whole table is denser than the sample and its neighbours nearer, so there the share is larger.
    """
    asked = as_query(sample[:AIM_QUERIES, :-1])
    distance = (sample**2).sum(1) - 2 * asked @ sample.T
    distance[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    n = min(nearest, len(sample) - 1)
    if n < 1:
        return len(centers)
    near = np.argpartition(distance, n - 1, axis=1)[:, :n]
    order = nearest_lists(asked, centers, len(centers))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centers)), order.shape), 1)
    ranks = np.take_along_axis(place, nearest_lists(sample, centers, 1)[:, 0][near], 1)
    return min(len(centers), max(LEAST_PROBED, int(np.quantile(ranks, aim, method="higher")) + 1))


def limit(bound: np.ndarray, read: int, dims: int, slack: float) -> np.ndarray:
    """The largest partial squared distance over ``read`` of ``dims`` dimensions that is plausible within the bound.

    Under a random rotation the part follows a beta distribution of mean read / dims.
    """
    deviation = np.sqrt(2 * (dims - read) / (read * (dims + 2)))
    return bound * (read / dims) * (1 + slack * deviation) + 1e-9


def adaptive_scan(queries: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, block: int = BLOCK_DIMS, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (row of ``queries``, row of ``vectors``) whose squared distance may be within the query's bound, and the dimensions read.

    Both sides are rotated. Without a finite bound all pairs stay.
    """
    dims = vectors.shape[1]
    first = dims if np.isinf(bounds).any() else min(block, dims)
    part = lambda x: (x[:, :first] ** 2).sum(1)
    partial = part(queries)[:, None] + part(vectors)[None, :] - 2 * queries[:, :first] @ vectors[:, :first].T
    q, v = np.nonzero(partial <= limit(bounds, first, dims, slack)[:, None])
    partial, read = partial[q, v], first * len(queries) * len(vectors)
    for at in range(first, dims, block):
        if not len(q):
            break
        end = min(at + block, dims)
        difference = queries[q, at:end] - vectors[v, at:end]
        read += difference.size
        partial += np.einsum("ij,ij->i", difference, difference)
        stays = partial <= limit(bounds[q], end, dims, slack)
        q, v, partial = q[stays], v[stays], partial[stays]
    return q, v, read


def best_of(owner: np.ndarray, score: np.ndarray, ties: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` largest scores of each owner, ties to the smaller of ``ties``; no number comes last."""
    order = np.lexsort((ties, -np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf), owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    return order[rank < keep]


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, every: int = QUERY_EVERY, aim: float = AIM, reads: tuple | None = None) -> DataFrame:
    """(query_id, rank, key, score): for each row whose id is divisible by ``every``, its nearest others.

    Nearness is the largest inner product of the original vectors in double precision, ties to the smaller
    id. Vectors that are null, zero or not finite, and rows without id, take no part; rows that repeat an id
    count once, with the smallest of their vectors. A product beyond the range of doubles is infinite, and one that
    is no number comes last. A query has fewer rows only if there are fewer candidates in all. Vectors of different
    lengths are an error. Other columns are not read. An empty table gives no rows.

    ``reads``: two accumulators, for the dimensions that were read and those that the probed lists hold.
    """
    spark = table.sparkSession
    schema = f"query_id long, rank int, {key} long, score double"
    rows = usable(table, key, vector).groupBy(F.col(key).cast("long").alias("id")).agg(F.min("vector").alias("vector"))
    kind = rows.schema["vector"].dataType.simpleString()
    # One class for each distinct vector: its smallest ids are all that can be among the nearest
    by_vector = Window.partitionBy("vector").orderBy("id")
    members = common.materialize(rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= nearest + 1), "members")
    heads = common.materialize(members.where("n = 1").select(F.col("id").alias("class"), "vector"), "heads")
    total, dims, scale = heads.agg(F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs))).cast("double")).first()
    if not total:
        return spark.createDataFrame([], schema)
    radius = float(np.sqrt(heads.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale)))).first()[0]))
    classes = members.join(heads.withColumnRenamed("class", "head"), "vector").select("head", "id")
    queries = common.materialize(rows.where(F.col("id") % every == 0).join(heads.withColumnRenamed("class", "head"), "vector").select(F.col("id").alias("query_id"), "head"), "queries")

    lists = int(min(MOST_LISTS, max(1, round(np.sqrt(total)))))
    sample = heads.orderBy(F.xxhash64("class"), "class").limit(FIT_VECTORS).toPandas()
    sample = lift(np.stack(sample["vector"].to_numpy()).astype(float), scale, radius)
    centers = fit_centroids(sample, min(lists, len(sample)))
    probed = lists_to_probe(sample, centers, nearest, aim)
    turn = np.linalg.qr(np.random.default_rng(11).normal(size=(dims + 1, dims + 1)))[0]
    shared = spark.sparkContext.broadcast((centers, turn))

    def deal(batches):
        for batch in batches:
            if len(batch):
                near = nearest_lists(lift(np.stack(batch["vector"].to_numpy()).astype(float), scale, radius), shared.value[0], 1)
                yield pd.DataFrame({"class": batch["class"], "vector": batch["vector"], "list": near[:, 0]})

    listed = common.materialize(heads.mapInPandas(deal, f"class long, vector {kind}, list long"), "listed")
    held = np.zeros(len(centers), np.int64)
    for r in listed.groupBy("list").count().collect():  # at most MOST_LISTS
        held[r["list"]] = r["count"]

    def ask(batches):
        """The lists that a query probes: so many, or more until they hold enough; the nearest of them are for the bound.

        A query has a row with its vector for each of its lists, so a few queries are taken at a time.
        """
        for whole in batches:
            step = max(1, STEP_ROWS // len(held))
            for batch in (whole.iloc[at : at + step] for at in range(0, len(whole), step)):
                order = nearest_lists(as_query(np.stack(batch["vector"].to_numpy()).astype(float)), shared.value[0], len(held))
                enough = (np.cumsum(held[order], axis=1) < nearest + 1).sum(1) + 1
                last = np.minimum(len(held), np.maximum(probed, enough))
                place = np.arange(len(held))
                row, at = np.nonzero(place[None, :] < last[:, None])
                first = np.maximum(enough, -(-last // BOUND_PART))
                yield pd.DataFrame({"class": batch["class"].to_numpy()[row], "vector": batch["vector"].to_numpy()[row], "list": order[row, at], "first": at < first[row]})

    asking = heads.join(queries.select(F.col("head").alias("class")).distinct(), "class", "left_semi").mapInPandas(ask, f"class long, vector {kind}, list long, first boolean")
    asking = common.materialize(asking, "asking")
    found = []
    for first in (True, False):
        asked = asking.where(F.col("first") == first).drop("first")
        if first:
            asked = asked.withColumn("bound", F.lit(None).cast("double"))
        else:  # the distance of the last of those found so far, if there are as many
            asked = asked.join(found[0].where(F.col("n") == nearest + 1).select(F.col("query").alias("class"), (2 - 2 * F.col("near")).alias("bound")), "class", "left")
        found.append(common.materialize(_scanned(asked, listed, shared, scale, radius, kind, nearest + 1, reads), "found"))
    found = _ranked(found[0].drop("n").unionByName(found[1].drop("n")), nearest + 1)
    # Put the copies back, without the query itself
    pairs = found.join(classes, found["class"] == classes["head"]).select("query", F.col("id").alias(key), "score")
    answers = queries.join(pairs, queries["head"] == pairs["query"]).where(F.col("query_id") != F.col(key)).select("query_id", key, "score")
    rank = Window.partitionBy("query_id").orderBy(*_order(), key)
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= nearest).select("query_id", "rank", key, "score")


def _order() -> list:
    return [F.isnan("score"), F.desc("score")]


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(*_order(), "class")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep)


def _scanned(asking: DataFrame, listed: DataFrame, shared, scale: float, radius: float, kind: str, keep: int, reads: tuple | None) -> DataFrame:
    """(query, class, score, near, n): the ``keep`` best that each query (class, vector, list, bound) finds in its lists."""
    # Chunks of bounded size on both sides: a vector is in one chunk and meets each chunk of its list's queries
    n_vectors = listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_VECTORS).cast("int").alias("vector_chunks"))
    n_queries = asking.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("query_chunks"))
    cuts = F.broadcast(n_vectors.join(n_queries, "list"))  # one row for each of at most MOST_LISTS lists
    mine = lambda chunks: F.pmod(F.xxhash64("class", F.lit(3)), F.col(chunks)).cast("int")
    each = lambda chunks: F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))
    listed = listed.join(cuts, "list").select("list", mine("vector_chunks").alias("v"), each("query_chunks").alias("q"), "class", "vector")
    asking = asking.join(cuts, "list").select("list", each("vector_chunks").alias("v"), mine("query_chunks").alias("q"), "class", "vector", "bound")

    def scan(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "class": np.zeros(0, np.int64), "score": np.zeros(0), "near": np.zeros(0)})]
        if len(ask) and len(have):
            turn = shared.value[1]
            plain, ids = np.stack(have["vector"].to_numpy()).astype(float), have["class"].to_numpy()
            lifted = lift(plain, scale, radius)
            rotated = lifted @ turn
            bounds = ask["bound"].to_numpy(float, na_value=np.inf)
            step = max(1, min(STEP_QUERIES, STEP_PAIRS // len(have)))
            for at in range(0, len(ask), step):
                some = slice(at, at + step)
                asked = np.stack(ask["vector"].to_numpy()[some]).astype(float)
                unit = as_query(asked)
                q, v, read = adaptive_scan(unit @ turn, rotated, bounds[some])
                if reads:
                    reads[0].add(read)
                    reads[1].add(len(asked) * rotated.size)
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,ij->i", asked[q], plain[v])
                best = best_of(q, score, ids[v], keep)
                q, v = q[best], v[best]
                out.append(pd.DataFrame({"query": ask["class"].to_numpy()[some][q], "class": ids[v], "score": score[best], "near": np.einsum("ij,ij->i", unit[q], lifted[v])}))
        return pd.concat(out)

    found = asking.groupBy("list", "v", "q").cogroup(listed.groupBy("list", "v", "q")).applyInPandas(scan, "query long, class long, score double, near double")
    return _ranked(found, keep)


def op4_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every query vector."""
    return search(common.table(spark, sf_dir, "embeddings"))
