"""Near-duplicate classes by MinHash with tensored banding.

A document's set holds the hashes of its distinct runs of five words. Two small collections A and B hold
``GROUPS`` keys each, a key made of ``PER_GROUP`` minima; every pair (A key, B key) is the key of one of
``GROUPS ** 2`` hash tables, so 56 minima give 196 tables of four minima each. A pair of sets that are
75 % alike is missed only if no A key or no B key agrees: 2 * (1 - 0.75 ** 2) ** 14, about 2e-5.

The tensor also saves the tables: a document shares a table only if it shares an A key and a B key, so keys
that a single set has are dropped first, and tables are formed from the few that remain.

Links are confirmed on the full sets, never all pairs of a bucket:

1. sets that are equal form one class at once, and only classes go on;
2. in each bucket every class is compared with one hub, the class whose keys most others share (in a group of
   edited copies that is the text they were copied from), and what is confirmed is joined;
3. of a class that still shares buckets with other components, ``reach`` counts the members of its set that
   any class of another component has. Two sets share no more than either reach, so most classes are ruled
   out by themselves. The rest are compared within tiles of bounded size: those outside an A key's largest
   component against those with that key, as products of 0/1 matrices, of which only links come out.

The bounds of step 3 are exact: no link between classes that share a table is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bytesvec import LOWER, U, Words, bytes_of, factor, mix, windows

WIDTH, GROUPS, PER_GROUP = 5, 14, 2
#: Members of all sets of a tile's two sides, about
TILE_MEMBERS = (100_000, 400_000)
#: Cells of a matrix that a tile's task holds at a time, about
TILE_CELLS = 1 << 24
HASHES = 2 * GROUPS * PER_GROUP
_RANDOM = np.random.default_rng(20240229)
_MASKS = _RANDOM.integers(0, 2**64, HASHES, dtype=U)
_FACTORS = _RANDOM.integers(0, 2**64, HASHES, dtype=U) | U(1)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text (of all its words, if fewer), and their bounds."""
    data, offsets = bytes_of(texts)
    words = Words(LOWER[data], offsets)
    hashes, counts = words.hashes(), words.counts()
    runs, bounds = windows(hashes, words.bounds, width)
    short = (counts > 0) & (counts < width)
    whole = counts.astype(U) * U(0xA0761D6478BD642F)
    for j in range(width - 1):
        rows = short & (counts > j)
        whole[rows] += hashes[words.bounds[:-1][rows] + j] * factor(width + j)
    runs = np.insert(runs, bounds[:-1][short], mix(whole)[short])
    return runs, bounds + np.concatenate([[0], np.cumsum(short)])


def set_key(members: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.array([mix(members).sum(dtype=U), mix(members ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U)


def signature(texts: pa.Array, width: int = WIDTH) -> list[pa.Array]:
    """Set size, set key (null for an empty set), A and B keys."""
    runs, bounds = shingles(texts, width)
    n = len(texts)
    sizes, keys = np.zeros(n, np.int64), np.zeros((n, 2), U)
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if b > a:
            one = np.unique(runs[a:b])
            sizes[i] = len(one)
            keys[i] = set_key(one)
    has = sizes > 0
    firsts = bounds[:-1][has]
    minima = np.zeros((n, HASHES), U)
    if len(firsts):
        for k in range(HASHES):
            minima[has, k] = np.minimum.reduceat((runs ^ _MASKS[k]) * _FACTORS[k], firsts)
    pairs = minima.reshape(n, 2 * GROUPS, PER_GROUP)
    groups = np.broadcast_to(np.arange(1, 2 * GROUPS + 1, dtype=U), (n, 2 * GROUPS))
    for j in range(PER_GROUP):
        groups = mix(groups * U(0x9FB21C651E98DF25) + pairs[:, :, j])
    groups = groups.view(np.int64)
    at = np.concatenate([[0], np.cumsum(has * GROUPS)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(side[has].ravel())) for side in (groups[:, :GROUPS], groups[:, GROUPS:])]
    return [
        pa.array(sizes),
        pa.array([k.tobytes() if h else None for h, k in zip(has, keys)], pa.binary()),
        *lists,
    ]


def _longs() -> T.ArrayType:
    return T.ArrayType(T.LongType())


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (u, v) is connected with.

    Each round takes the smallest label among neighbours and then the label of that label. Rounds are
    written to the shared folder; they end when no label falls, after some log(diameter) of them.
    """
    edges = common.materialize(links.select("u", "v").union(links.select("v", "u")).distinct(), "edges")
    labels = common.materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, edges.u == labels.node).groupBy("v").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels.node == heard.v).select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        lower = common.materialize(lower, "labels")
        target = lower.select(F.col("node").alias("over"), F.col("label").alias("next"))
        jumped = lower.join(target, lower.label == target.over).select("node", F.col("next").alias("label"), "was")
        jumped = common.materialize(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label < was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * shared >= ``percent`` * union over their sets; ``component_id`` is the
    smallest doc_id reachable. A null, empty or blank text has an empty set and is linked with nothing; a
    row without doc_id takes part as text but names no component. Rows that repeat a doc_id count as
    documents of that id. Other columns are not returned. An empty table gives an empty result. Texts are read in
    slices of about a megabyte; a longer text is a slice of its own, and needs some 20 bytes of memory a byte.
    """
    out = with_components(docs.select("doc_id", "text"), percent, width)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def with_components(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """``docs`` without text, and with n_shingles, component_id and ``component``: a key of the component, null for an empty set."""
    others = [c for c in docs.columns if c != "text"]
    source = docs.select("doc_id", "text")
    kinds = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("a", _longs()), T.StructField("b", _longs())]
    signed = common.materialize(common.with_batch_columns(docs, "text", kinds, lambda: lambda x: signature(x, width), ("text",)), "signed")
    classes = common.materialize(signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n_shingles", "a", "b"))), "classes")

    # Tables of those keys alone that several classes have
    keys = classes.select("set_key", F.posexplode(F.concat("a", "b")).alias("slot", "key"))
    shared = common.materialize(keys.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1"), "shared-keys")
    lists = keys.join(shared, "key").groupBy("set_key").agg(F.sum("holders").alias("weight"), F.collect_list(F.when(F.col("slot") < GROUPS, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("slot") >= GROUPS, F.col("key"))).alias("b"))
    lists = common.materialize(lists, "lists")
    cells = lists.select("set_key", "weight", F.explode("a").alias("x"), "b").select("set_key", "weight", "x", F.explode("b").alias("y")).select("set_key", "weight", F.xxhash64("x", "y").alias("cell"))
    cells = common.materialize(cells, "cells")

    hubs = cells.groupBy("cell").agg(F.max(F.struct("weight", "set_key")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("cell", F.col("hub.set_key").alias("u"))
    hubs = common.materialize(hubs, "hubs")
    stars = common.materialize(cells.join(hubs, "cell").where("u <> set_key").select("u", F.col("set_key").alias("v")).distinct(), "stars")
    sets = sets_of(stars, classes, source, width)
    links = common.materialize(confirmed(stars, sets, percent), "links")
    labels = components(links)

    # What shares a bucket and is not connected yet
    label = F.coalesce("label", "set_key").alias("label")
    placed = common.materialize(cells.join(labels, cells.set_key == labels.node, "left").select("cell", "set_key", label), "placed")
    mixed = common.materialize(placed.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("cell"), "mixed")
    apart = common.materialize(placed.join(mixed, "cell", "left_semi"), "apart")
    held = sets.join(apart.select("set_key", "label").distinct(), "set_key").select("set_key", "label", F.size("members").alias("size"), F.explode("members").alias("member"))
    held = common.materialize(held, "held")
    across = common.materialize(held.groupBy("member").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("member"), "across")
    reach = held.join(across, "member", "left_semi").groupBy("set_key").agg(F.first("size").alias("size"), F.count("*").alias("reach")).where(100 * F.col("reach") >= percent * F.col("size"))
    reach = common.materialize(reach, "reach")
    left = reach.join(apart.select("set_key", "label").distinct(), "set_key").join(lists.select("set_key", F.explode("a").alias("key")), "set_key")
    links_apart = common.materialize(tile_links(common.materialize(left, "left"), sets, percent), "links")
    if not links_apart.isEmpty():
        links = links.union(links_apart)
        labels = components(links)

    ends = common.materialize(classes.select("set_key", "first_id").join(labels, classes.set_key == labels.node, "left").select("set_key", "first_id", F.coalesce("label", "set_key").alias("label")), "ends")
    names = common.materialize(ends.groupBy("label").agg(F.min("first_id").alias("component_id")), "names")
    named = common.materialize(ends.join(names, "label").select("set_key", "component_id", F.col("label").alias("component")), "named")
    out = signed.select(*others, "n_shingles", "set_key").join(named, "set_key", "left").drop("set_key")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def one_of_each(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest doc_id, all columns as they are.

    Ids that are null come last, ties go by a hash of the text, and of rows equal in both one stays. A text without
    words is like no other, so all such rows stay. Every column is returned, whatever its name; an empty table
    stays empty.
    """
    keyed = common.packed(docs, "doc_id", "text").withColumn("_key", F.xxhash64("text"))
    placed = with_components(keyed.select("doc_id", "text", "_key"), percent, width)
    placed = placed.withColumn("_alone", F.when(F.col("component").isNull(), F.struct("doc_id", "_key")))
    counted = placed.groupBy("component", "_alone", "doc_id", "_key").agg(F.count("*").alias("n"))
    best = counted.groupBy("component", "_alone").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "n")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best._key").alias("_of"), F.when(F.col("component").isNull(), 1).otherwise(F.col("best.n")).alias("_n"))
    best = common.materialize(best, "stay")
    met = lambda some: keyed.join(some, keyed.doc_id.eqNullSafe(some._id) & (keyed._key == some._of), "left_semi")
    out, repeated = met(best.where("_n = 1")), best.where("_n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(met(repeated).dropDuplicates(["doc_id", "_key"]))
    return common.unpacked(out, docs.columns, "doc_id", "text")


def tile_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) across components among classes (set_key, label, size, key) that share a key, repeats included.

    Each key's classes outside its largest component are one side and all its classes the other; both are cut
    by hash into chunks of bounded total set size, and every pair of chunks is a task's group.
    """
    by_label = left.groupBy("key", "label").agg(F.sum("size").alias("members"), F.count("*").alias("n"))
    spans = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("members").alias("every"), (F.sum("members") - F.max_by("members", F.struct("n", "label"))).alias("others")).where("others > 0")
    cut = lambda total, most: F.ceil(F.col(total) / most).cast("int")
    spans = common.materialize(spans.select("key", "main", cut("others", TILE_MEMBERS[0]).alias("n_x"), cut("every", TILE_MEMBERS[1]).alias("n_y")), "spans")
    placed = left.join(spans, "key")
    mine = lambda n: F.pmod(F.xxhash64("set_key", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = placed.where("label <> main").select("key", mine("n_x").alias("i"), each("n_y").alias("j"), F.col("set_key").alias("u"), "label")
    y = placed.select(F.col("key").alias("y_key"), each("n_x").alias("y_i"), mine("n_y").alias("y_j"), F.col("set_key").alias("v"), F.col("label").alias("y_label"))

    def compare(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"u": [], "v": []}, dtype=object)
        if not len(xs) or not len(ys):
            return empty
        x_sizes, y_sizes = xs["members"].map(len).to_numpy(), ys["y_members"].map(len).to_numpy()
        x_all, y_all = np.concatenate(xs["members"].tolist()), np.concatenate(ys["y_members"].tolist())
        names = _shared_names(x_all, np.repeat(xs["u"].to_numpy(), x_sizes), y_all, np.repeat(ys["v"].to_numpy(), y_sizes))
        if not len(names):
            return empty
        x_bounds, y_bounds = (np.concatenate([[0], np.cumsum(s)]) for s in (x_sizes, y_sizes))
        rows, out = max(1, TILE_CELLS // len(names)), []
        for y_at in range(0, len(ys), rows):
            y_part = slice(y_at, y_at + rows)
            y_some = y_sizes[y_part]
            y_matrix = _matrix(y_all[y_bounds[y_at] : y_bounds[y_at + len(y_some)]], y_some, names)
            for at in range(0, len(xs), min(rows, 64)):
                part = slice(at, at + min(rows, 64))
                sizes = x_sizes[part]
                shared = (_matrix(x_all[x_bounds[at] : x_bounds[at + len(sizes)]], sizes, names) @ y_matrix.T).astype(np.int64)
                alike = (100 + percent) * shared >= percent * (sizes[:, None] + y_some[None, :])
                alike &= xs["label"].to_numpy()[part][:, None] != ys["y_label"].to_numpy()[y_part][None, :]
                out.extend((xs["u"].iat[at + a], ys["v"].iat[y_at + b]) for a, b in zip(*np.nonzero(alike)))
        return pd.DataFrame(out, columns=["u", "v"], dtype=object) if out else empty

    x = x.join(sets.select(F.col("set_key").alias("u"), "members"), "u")
    y = y.join(sets.select(F.col("set_key").alias("v"), F.col("members").alias("y_members")), "v")
    return x.groupBy("key", "i", "j").cogroup(y.groupBy("y_key", "y_i", "y_j")).applyInPandas(compare, "u binary, v binary")


def _shared_names(x_all: np.ndarray, x_owner: np.ndarray, y_all: np.ndarray, y_owner: np.ndarray) -> np.ndarray:
    """Members that a set of x and another set of y hold: those of both sides, but for what one set alone holds on both."""
    x_names, x_at, x_counts = np.unique(x_all, return_index=True, return_counts=True)
    y_names, y_at, y_counts = np.unique(y_all, return_index=True, return_counts=True)
    names, i, j = np.intersect1d(x_names, y_names, assume_unique=True, return_indices=True)
    own = (x_counts[i] == 1) & (y_counts[j] == 1) & (x_owner[x_at[i]] == y_owner[y_at[j]])
    return names[~own]


def _matrix(members: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of ``names`` each set holds, as 0 and 1."""
    out = np.zeros((len(sizes), len(names)), np.float32)
    at = np.minimum(np.searchsorted(names, members), len(names) - 1)
    has = names[at] == members
    out[np.repeat(np.arange(len(sizes)), sizes)[has], at[has]] = 1
    return out


def sets_of(pairs: DataFrame, classes: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """(set_key, members) of the classes in ``pairs``: their full sets, from one text each."""
    nodes = pairs.select(F.col("u").alias("set_key")).union(pairs.select("v")).distinct()
    wanted = classes.join(nodes, "set_key", "left_semi").select(F.col("first_id").alias("wanted_id"))

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            runs, bounds = shingles(texts, width)
            found = [np.unique(runs[a:b]) for a, b in zip(bounds, bounds[1:])]
            return [pa.array([set_key(s).tobytes() for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]

        return compute

    texts = source.join(wanted, source.doc_id.eqNullSafe(wanted.wanted_id), "left_semi").select("text")
    sets = common.with_batch_columns(texts, "text", [T.StructField("set_key", T.BinaryType()), T.StructField("members", _longs())], make, ("text",))
    return common.materialize(sets.dropDuplicates(["set_key"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are alike enough."""
    x, y = (sets.select(F.col("set_key").alias(c), F.col("members").alias(f"{c}_set")) for c in "uv")
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(x, "u").join(y, "v").where(100 * both >= percent * (F.size("u_set") + F.size("v_set") - both)).select("u", "v")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: The same by comparing all documents that share a run of words.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS run FROM split
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared s JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * s.n >= 75 * (p.n + q.n - s.n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON r.other = e.x)
SELECT d.doc_id, coalesce(max(z.n), 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""
