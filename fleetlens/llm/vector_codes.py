"""Vectors as short codes: product quantisation whose codebooks are refined by Lloyd's rounds over cover trees.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook. Every partition cuts its own
vectors into blocks and builds a cover tree over each part position of a block: a node is a point and a radius around it,
its children are points of its set more than half the radius apart from each other, each with the points nearer than
that. Points stand in the order of the tree, so a subtree is a range, and running sums along that order
give the sum of any subtree at once. Blocks are written once and read by every round.

A round walks the trees from the root. If all other entries are farther from a node's point than its nearest by more than
the node's diameter, they are so from every point below (triangle inequality) and the whole subtree is assigned by its sums. Entries
that are too far to be any point's nearest are struck out for what is below, and only ambiguous nodes descend; at the
leaves points are compared one by one with what is left. Arithmetic is exact in integers, so the trees decide how much is
computed and never what comes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and points of a tree that are compared one by one
BLOCK, LEAF = 2048, 8
#: Distances are sums of squares below this, so that doubles hold them exactly
EXACT = 1 << 52


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """[points, entries] squared distances, whole numbers held exactly in doubles."""
    a, b = points.astype(np.float64), entries.astype(np.float64)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """The tree over ``points`` [n, d]: order (of the points), and for each node center, radius, begin, end and children's range.

    Nodes are listed level by level, so the children of a node stand in a row.
    """
    order = np.arange(len(points))
    center, radius, begin, end, kids = [0], [0.0], [0], [len(points)], []
    at = 0
    while at < len(center):
        own = order[begin[at] : end[at]].copy()
        apart = squared(points[center[at]][None], points[own])[0]
        reach = float(apart.max())
        radius[at] = np.sqrt(reach)
        first = len(center)
        if reach > 0 and len(own) > leaf:
            left, far, start = own, apart, begin[at]
            pick = center[at]  # a node's point is the point of its first child too
            while len(left):
                near = far <= reach / 4
                order[start : start + int(near.sum())] = left[near]
                center.append(pick)
                radius.append(0.0)
                begin.append(start)
                start += int(near.sum())
                end.append(start)
                left, apart = left[~near], apart[~near]
                if len(left):
                    pick = left[apart.argmax()]  # the farthest of what is not covered
                    far = squared(points[pick][None], points[left])[0]
        kids.append((first, len(center)))
        at += 1
    return {"order": order, "center": np.array(center), "radius": np.array(radius), "begin": np.array(begin), "end": np.array(end), "kids": np.array(kids).reshape(-1, 2)}


def assign(tree: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begins, ends, entry) of ranges of the tree's order whose points all have that nearest entry (the first of those that tie)."""
    nodes, open_ = np.array([0]), np.ones((1, len(entries)), bool)
    ordered = points[tree["order"]]
    while len(nodes):
        far = np.where(open_, squared(points[tree["center"][nodes]], entries), np.inf)
        nearest = far.argmin(1)
        far = np.sqrt(far)
        width = tree["radius"][nodes]
        # Rounding of roots is far below one part in 2**40
        open_ = far <= (far[np.arange(len(nodes)), nearest] + 2 * width)[:, None] * (1 + 2.0**-40)
        whole = (width == 0) | (open_.sum(1) == 1)
        yield tree["begin"][nodes[whole]], tree["end"][nodes[whole]], nearest[whole]
        nodes, open_ = nodes[~whole], open_[~whole]
        kids = tree["kids"][nodes]
        counts = kids[:, 1] - kids[:, 0]
        leaves = np.flatnonzero(counts == 0)
        if len(leaves):
            sizes = tree["end"][nodes[leaves]] - tree["begin"][nodes[leaves]]
            at = np.repeat(tree["begin"][nodes[leaves]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            exact = np.where(open_[np.repeat(leaves, sizes)], squared(ordered[at], entries), np.inf)
            yield at, at + 1, exact.argmin(1)
        nodes, open_ = np.repeat(kids[:, 0] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()), np.repeat(open_, counts, axis=0)


TREE = ("order", "center", "radius", "begin", "end", "kids")


def blocks(vectors: DataFrame, width: int, parts: int = PARTS, size: int = BLOCK) -> DataFrame:
    """One row a block of a partition's vectors, of at most ``size``: their _row structs, points and, for each part position, a tree.

    ``vectors`` has _row and _ints (array of long, at most ``width`` of them; what is missing counts as zeros).
    """
    row = vectors.schema["_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed(table: pa.Table) -> pa.RecordBatch:
            lists = table.column("_ints").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            points = np.zeros((len(lists), width), np.int64)
            points[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            top = int(np.abs(points).max(initial=0))
            if 4 * width * top * top >= EXACT:
                raise ValueError(f"a component of {top} is too large: squared distances of {width} components must stay below {EXACT}")
            cut = points.reshape(len(points), parts, -1)
            trees = [cover_tree(cut[:, p]) for p in range(parts)]
            arrays = [pa.array([table.column("_row").combine_chunks().to_pylist()], pa.list_(table.schema.field("_row").type)), pa.array([points.astype(np.int32).tobytes()])]
            arrays += [pa.array([[t[name].astype(np.float64 if name == "radius" else np.int32).tobytes() for t in trees]], pa.list_(pa.binary())) for name in TREE]
            return pa.RecordBatch.from_arrays(arrays, names=["rows", "points", *TREE])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= size:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, size))
                held = table.slice(size).to_batches()
                n -= size
        if n:
            yield packed(pa.Table.from_batches(held))

    schema = f"rows array<{row.dataType.simpleString()}>, points binary, {', '.join(f'{name} array<binary>' for name in TREE)}"
    return vectors.select("_row", "_ints").mapInArrow(run, schema)


def _read(row: dict, width: int, parts: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Points and tree of each part position of a block."""
    points = np.frombuffer(row["points"], np.int32).reshape(-1, parts, width // parts).astype(np.int64)
    for p in range(parts):
        tree = {name: np.frombuffer(row[name][p], np.float64 if name == "radius" else np.int32) for name in TREE}
        tree["kids"] = tree["kids"].reshape(-1, 2)
        yield points[:, p], tree


def entry_sums(built: DataFrame, codebooks: np.ndarray, width: int) -> DataFrame:
    """(part, entry, place, total): of the points assigned to each entry the sum of each component, and at place -1 their number.

    Each task adds up its own blocks first, so as many rows as codebooks have numbers leave it at most.
    """
    parts, n, depth = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, n, depth + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, (points, tree) in enumerate(_read(row, width, parts)):
                    ones = np.concatenate([np.ones((len(points), 1), np.int64), points[tree["order"]]], axis=1)
                    running = np.concatenate([np.zeros((1, depth + 1), np.int64), np.cumsum(ones, axis=0)])
                    for begins, ends, entry in assign(tree, points, codebooks[p]):
                        np.add.at(total[p], entry, running[ends] - running[begins])
        part, entry, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place - 1), pa.array(total[part, entry, place])], names=["part", "entry", "place", "total"])

    return built.drop("rows").mapInArrow(run, "part long, entry long, place long, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def refined(built: DataFrame, codebooks: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its points, unused ones as they are."""
    sums = np.zeros((*codebooks.shape[:2], codebooks.shape[2] + 1), np.int64)
    for part, entry, place, total in entry_sums(built, codebooks, width).collect():  # as many rows as codebooks have numbers, at most
        sums[part, entry, place + 1] = total
    return np.where(sums[:, :, :1] > 0, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), codebooks)


def coded(built: DataFrame, codebooks: np.ndarray, width: int) -> DataFrame:
    """The rows of the blocks with _code (two hex digits for each part, more for codebooks beyond 256) and _error."""
    parts, digits = len(codebooks), max(2, len(f"{max(codebooks.shape[1] - 1, 0):x}"))
    row = built.schema["rows"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.drop_columns(["rows"]).to_pylist()):
                own = batch.column("rows").slice(i, 1).flatten()
                codes, error = np.zeros((len(own), parts), np.int64), np.zeros(len(own), np.int64)
                for p, (points, tree) in enumerate(_read(block, width, parts)):
                    for begins, ends, entry in assign(tree, points, codebooks[p]):
                        sizes = ends - begins
                        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                        codes[tree["order"][at], p] = np.repeat(entry, sizes)
                    error += ((points - codebooks[p][codes[:, p]]) ** 2).sum(1)
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([own, pa.array(text), pa.array(error)], names=["_row", "_code", "_error"])

    return built.mapInArrow(run, f"_row {row.simpleString()}, _code string, _error long")


def smallest_ids(some: DataFrame, n: int) -> list:
    """The ``n`` smallest distinct ids, as a top-n without a shuffle; again behind the last one as long as repeated ids leave some to find."""
    ids: list = []
    while len(ids) < n:
        ahead = some.where("vec_id is not null" if not ids else F.col("vec_id") > ids[-1])
        more = sorted({r[0] for r in ahead.select("vec_id").orderBy("vec_id").limit(n).collect()})
        if not more:
            break
        ids += more[: n - len(ids)]
    return ids


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every usable vector, and the codebooks [part, entry, component].

    Vectors that are null or hold null or non-finite components have no row. Codebooks begin as the parts of the
    ``entries`` smallest ids' vectors (an id that repeats counts once there, by its smallest vector; null ids do not count); there are fewer entries
    if there are fewer ids. Rows that repeat an id have a row each. Ties go to the lower entry. Vectors that are shorter than the longest one,
    or not a multiple of ``parts`` long, count as if zeros followed. Null labels are a label of their own. Without a usable
    vector, or with null ids alone, there is no row. Other columns are not read. Components beyond some millions (``EXACT``) are an error.
    """
    some = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("_vector")).where(usable(F.col("_vector")))
    kept = some.select(F.struct("vec_id", "label").alias("_row"), integers(F.col("_vector"), scale).alias("_ints"))
    longest = some.agg(F.coalesce(F.max(F.size("_vector")), F.lit(0))).first()[0]
    width = -(-longest // parts) * parts
    ids = smallest_ids(some, entries)
    first = kept.where(F.col("_row.vec_id").isin(ids)).groupBy("_row.vec_id").agg(F.min("_ints").alias("v")) if ids else None
    start = [r["v"] + [0] * (width - len(r["v"])) for r in sorted(first.collect(), key=lambda r: r["vec_id"])] if ids else []
    codebooks = np.array(start, np.int64).reshape(len(start), parts, -1 if start and width else 0).transpose(1, 0, 2)
    if not start or not width:
        empty = kept.where(F.lit(False)).select("_row.vec_id", "_row.label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, codebooks
    built = common.materialize(blocks(kept, width, parts), "blocks")
    for _ in range(rounds):
        codebooks = refined(built, codebooks, width)
    rows = common.materialize(coded(built, codebooks, width).select("_row.vec_id", "_row.label", F.col("_code").alias("code"), F.col("_error").alias("error")), "codes")
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), codebooks


def digest(codebooks: np.ndarray) -> str:
    """The digest of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code and errors."""
    rows, codebooks = compress(common.table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in SQL, every part against every entry in every round."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS (SELECT k, part, arg_min({{'d': d, 'entry': entry}}, (d, entry)) AS a FROM (
  SELECT p.k, p.part, e.entry, sum((p.v - e.v) * (p.v - e.v)) AS d FROM pieces p JOIN book{i} e ON e.part = p.part AND e.place = p.place GROUP BY ALL) GROUP BY k, part)""")
        if i < ROUNDS:
            steps.append(f"""book{i + 1} AS (SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
  SELECT p.part, n.a.entry AS entry, p.place, CAST((sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM pieces p JOIN near{i} n ON n.k = p.k AND n.part = p.part GROUP BY ALL) m
  ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)""")
    return f"""
WITH usable AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
size AS (SELECT max(len(ints)) // {PARTS} AS depth FROM usable),
pieces AS (SELECT k, (i - 1) // depth AS part, (i - 1) % depth AS place, ints[i] AS v FROM (SELECT k, ints, unnest(range(1, len(ints) + 1)) AS i FROM usable), size),
book0 AS (SELECT part, entry, place, v FROM pieces JOIN (SELECT k, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM usable) f USING (k) WHERE entry < {ENTRIES}),
{', '.join(steps)},
errors AS (SELECT k, string_agg(printf('%02x', CAST(a.entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY k),
labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM errors JOIN usable USING (k) GROUP BY label)
SELECT u.vec_id, code, error, label_error, (SELECT sha256(string_agg(v, ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
FROM usable u JOIN errors USING (k) JOIN labels l ON l.label IS NOT DISTINCT FROM u.label
"""
