"""Mixing sources to target weights by blocks.

Each source's documents, in doc_id order, form one stream of words that is cut into blocks of
``BLOCK_WORDS``. Each output shard draws how many slots go to each source from a multinomial; a source's
slots are numbered through the shards, and slot number s stands for the block that a pseudorandom
permutation of the source's block numbers (another one each time round) puts at s. Slots and blocks meet in
a join on (source, block number), so nothing depends on how large a source is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WEIGHTS, MAX_REPEAT, BLOCK_WORDS, SLOTS_PER_SHARD, SEED = (1, 2, 3), 3, 128, 4096, 17
#: Sources that are drawn among at a time, and shards that a task draws for at a time
GROUP_SOURCES, CHUNK_SHARDS = 100_000, 10_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_running_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one.

    Rows are dealt out by ranges of the order, summed within each range, and shifted by the total of the
    ranges before (one row for each partition, so small enough to broadcast).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_total"))
    shift = totals.withColumn("_shift", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(shift), "_range").withColumn(out, F.col(out) + F.col("_shift")).drop("_range", "_shift")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """(source, rank, source_size, source_start, target) from (source, size).

    Sources stand in code-point order, null last, and weigh ``weights`` in turn. A target is the source's
    share of all sizes by weight, but ``most`` times its size at most; what that leaves over is shared among
    the others by weight until none is above. Nothing to share gives targets of 0.
    """
    order = [F.col("source").isNull(), F.col("source")]
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = with_running_sum(sources, order, "_one", "rank")
    ranked = with_running_sum(ranked, order, "source_size", "source_start").drop("_one")
    of_rank = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = common.materialize(ranked.withColumn("weight", of_rank.cast("double")), "sources")
    cap = (most * F.col("source_size")).cast("double")
    total, unit, before = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, None
    while total:
        full = cap <= unit * F.col("weight")
        capped, weight, n = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == before or not weight:
            break
        unit, before = (total - capped) / weight, n
    return ranked.withColumn("target", F.least(cap, unit * F.col("weight")))


def permuted(position: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. size - 1 puts each position: four Feistel rounds, again until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, todo = position.astype(np.uint64), np.arange(len(position))
    while len(todo):
        h, m, v, s = half[todo], low[todo], x[todo], seed[todo].astype(np.uint64)
        left, right = v >> h, v & m
        for turn in range(4):
            z = (right + s + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z >> np.uint64(32)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo].astype(np.uint64)]
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def permuted_udf(position: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permuted(position.to_numpy(), size.to_numpy(), seed.to_numpy()))


def draw_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """(shard, rank, slot, block): which block of which source each slot of each output shard takes.

    A source's quota of slots is its target in blocks of its mean length. Shards draw their counts from a
    multinomial over the quotas; draws beyond a quota are left out, and one closing shard takes what the
    draws have left of the quotas, so every quota is met exactly.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - rounds * F.col("source_size")) * blocks / F.col("source_size"))
    quotas = sources.where("source_size > 0").select("rank", blocks.alias("blocks"), (rounds * blocks + rest).cast("long").alias("quota")).where("quota > 0")
    quotas = common.materialize(quotas, "quotas")
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = -(-total // per_shard)
    # A multinomial in two steps: how many slots go to each group of sources, then to each source of a group
    group = F.floor(F.col("rank") / GROUP_SOURCES).alias("group")
    groups = quotas.groupBy(group).agg(F.sum("quota").alias("quota")).orderBy("group").collect()  # one row for 100,000 sources
    names, odds = np.array([r["group"] for r in groups], np.int64), np.array([r["quota"] for r in groups]) / max(total, 1)

    def draw_groups(batches):
        for batch in batches:
            for shard in batch["id"]:
                counts = np.random.default_rng([seed, shard]).multinomial(min(per_shard, total - shard * per_shard), odds)
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "group": names[some], "n": counts[some]})

    def draw_sources(slots: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"shard": np.zeros(0, np.int64), "rank": np.zeros(0, np.int64), "drawn": np.zeros(0, np.int64)})]
        sources = sources.sort_values("rank")
        ranks, parts = sources["rank"].to_numpy(), sources["quota"].to_numpy()
        for shard, one, n in zip(slots["shard"].tolist(), slots["group"].tolist(), slots["n"].tolist()):
            counts = np.random.default_rng([seed, shard, one]).multinomial(n, parts / parts.sum())
            some = np.flatnonzero(counts)
            out.append(pd.DataFrame({"shard": shard, "rank": ranks[some], "drawn": counts[some]}))
        return pd.concat(out)

    chunks = max(1, -(-shards // CHUNK_SHARDS))
    slots = spark.range(shards).mapInPandas(draw_groups, "shard long, group long, n long").withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS))
    members = quotas.select("rank", "quota", group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    drawn = slots.groupBy("group", "chunk").cogroup(members.groupBy("group", "chunk")).applyInPandas(draw_sources, "shard long, rank long, drawn long")
    drawn = common.materialize(drawn, "draws")
    # Slot numbers run through the shards source by source: a running sum over (source, shard), less the source's own start
    numbered = with_running_sum(drawn, [F.col("rank"), F.col("shard")], "drawn", "at")
    starts = numbered.groupBy("rank").agg(F.min("at").alias("start"), F.sum("drawn").alias("all_drawn"))
    spans = numbered.join(starts, "rank").join(quotas, "rank").select("shard", "rank", "blocks", (F.col("at") - F.col("start")).alias("a"), F.least(F.col("at") - F.col("start") + F.col("drawn"), "quota").alias("z"))
    closing = quotas.join(starts, "rank", "left").select(F.lit(shards).cast("long").alias("shard"), "rank", "blocks", F.coalesce("all_drawn", F.lit(0)).alias("a"), F.col("quota").alias("z"))
    slots = spans.unionByName(closing).where("a < z").select("shard", "rank", "blocks", F.explode(F.sequence("a", F.col("z") - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    return slots.withColumn("block", permuted_udf(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64("rank", turn, F.lit(seed)))).drop("blocks")


def drawn_pieces(docs: DataFrame, block_words: int, weights: tuple[int, ...], most: int, per_shard: int, seed: int, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents' places in the streams of their sources, and their pieces in blocks with the slots of each.

    A piece has ``first`` (words of the document before it), ``words`` and ``times``; ``extra`` columns of
    ``docs`` pass through.
    """
    sizes = common.materialize(docs.select("doc_id", "source", *extra, word_count().alias("size")), "sizes")
    sources = common.materialize(source_targets(sizes, weights, most), "targets")
    drawn = draw_slots(sources, block_words, per_shard, seed).groupBy("rank", "block").agg(F.count("*").alias("times"))
    streams = with_running_sum(sizes, [F.col("source").isNull(), F.col("source"), F.col("doc_id"), F.col("size"), *map(F.col, extra)], "size", "at")
    placed = streams.join(F.broadcast(sources) if sources.count() <= 1000 else sources, streams.source.eqNullSafe(sources.source)).select("doc_id", streams.source, *extra, "size", "source_size", "target", "rank", (F.col("at") - F.col("source_start")).alias("at"))
    placed = common.materialize(placed, "placed")
    block = F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)))
    pieces = placed.where("size > 0").select("*", block.alias("block"))
    begin = F.greatest(F.col("block") * block_words, F.col("at"))
    words = F.least((F.col("block") + 1) * block_words, F.col("at") + F.col("size")) - begin
    # Spark takes the listed blocks to be as small as the file that they are listed from, and would broadcast them all
    pieces = pieces.hint("merge").join(drawn, ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return placed, pieces.withColumn("first", begin - F.col("at")).withColumn("words", words)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    ``size`` counts words; a null or empty text has none and is never taken. Rows without a source form
    the last source; rows that repeat a doc_id, or have none, are documents like any other. ``taken`` counts
    the document's words in the mix, repeats counted: the words of its blocks times the slots of each. Other
    columns are not returned; an empty table gives an empty result. Reruns agree.
    """
    placed, pieces = drawn_pieces(docs, block_words, weights, most, per_shard, seed)
    taken = pieces.groupBy("rank", "at", "doc_id", "source", "size", "source_size", "target").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """The texts of the mix, with the columns of ``docs``: together exactly the words that ``mix`` calls taken.

    Copy number c of a document is made of its blocks that have c slots or more, a row for each run of
    neighbouring blocks: the text itself if that is all of it, otherwise the run's words with the white space
    that follows each. The other columns are the document's own, whatever their names. Rows without words are
    never taken; rows that repeat a doc_id, or have none, are documents like any other.
    """
    kept = ("doc_id", "source", "text")
    numbered = common.materialize(common.packed(docs, *kept).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    _, pieces = drawn_pieces(numbered, block_words, weights, most, per_shard, seed, ("_place",))
    copies = pieces.where("times > 0").select("_place", "block", "first", "words", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    run = F.col("block") - F.row_number().over(Window.partitionBy("_place", "copy").orderBy("block"))
    runs = copies.withColumn("run", run).groupBy("_place", "copy", "run").agg(F.min("first").alias("first"), F.sum("words").alias("n"), F.first("size").alias("size"))
    runs = runs.groupBy("_place").agg(F.sort_array(F.collect_list(F.struct("copy", "first", "n"))).alias("_runs"), F.first("size").alias("_size"))
    whole = F.transform("_runs", lambda r: F.col("text"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = lambda w, r: F.when(r["n"] == F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(w, (r["first"] + 1).cast("int"), r["n"].cast("int")), ""))
    parts = F.transform(F.array(words), lambda w: F.transform("_runs", lambda r: cut(w, r)))[0]  # so that a text is split once
    texts = F.when(F.forall("_runs", lambda r: r["n"] == F.col("_size")), whole).otherwise(parts)
    out = numbered.join(runs, "_place").withColumn("text", F.explode(texts))
    return common.unpacked(out, docs.columns, *kept)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    return mix(common.table(spark, sf_dir, "documents")).drop("source")
