import math
import random
import re

import numpy as np
from pyspark.sql import functions as F
import pytest

from fleetlens.llm import common, mixing
from .conftest import EDGES, SMALL


def targets(sizes):
    """By taking turns: fix whoever is above, share out the rest."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3.0 * sizes[s] for s in above)
        free -= above
    return out


def check(rows, docs, near):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    wanted = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= near
    return wanted


def test_table_and_reruns(spark):
    docs = common.table(spark, SMALL, "documents")
    rows = mixing.mix(docs, per_shard=100).collect()
    check(rows, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()], mixing.BLOCK_WORDS)
    again = mixing.mix(docs.repartition(7), per_shard=100).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_edges(spark, edge_docs):
    rows = mixing.mix(edge_docs, block_words=4, per_shard=10).collect()
    wanted = check(rows, [tuple(r) for r in edge_docs.select("doc_id", "text", "source").collect()], 4)
    assert None in wanted
    repeated = edge_docs.unionByName(edge_docs).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    rows = mixing.mix(repeated, block_words=4, per_shard=10).collect()
    check(rows, [tuple(r) for r in repeated.select("doc_id", "text", "source").collect()], 4)
    assert mixing.mix(edge_docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(edge_docs.where("trim(text) = '' or text is null")).collect()} == {0}
    assert len(EDGES) * 2 == len(rows)


def test_capped_small_source(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "a") for i in range(100)] + [(1000, "x y z", "b"), (1001, "q", "c")], "doc_id long, text string, source string")
    rows = mixing.mix(docs, block_words=16, per_shard=64).collect()
    check(rows, [tuple(r) for r in docs.collect()], 16)
    assert {r["taken"] for r in rows if r["source"] == "b"} == {9}


def test_draws_in_groups_of_sources(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = spark.createDataFrame([(f"s{i:02d}", int(rng.integers(50, 4000))) for i in range(23)], "source string, size long")
    sources = common.materialize(mixing.source_targets(sizes), "targets")
    wanted = None
    for group, chunk in ((100_000, 10_000), (5, 3), (1, 1)):
        monkeypatch.setattr(mixing, "GROUP_SOURCES", group)
        monkeypatch.setattr(mixing, "CHUNK_SHARDS", chunk)
        slots = mixing.draw_slots(sources, block_words=10, per_shard=100)
        by_source = {r["rank"]: r["count"] for r in slots.groupBy("rank").count().collect()}
        assert wanted is None or by_source == wanted
        wanted = by_source
        assert slots.groupBy("shard").count().where("count > 100").where(f"shard < {sum(wanted.values()) // 100}").count() == 0


def replayed(sources, block_words, per_shard, seed=mixing.SEED):
    """How often each block of each rank is taken, by the same draws one after another."""
    quotas = []
    for r in sorted(sources, key=lambda r: r["rank"]):
        blocks = -(-r["source_size"] // block_words)
        rounds = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        rest = int(math.floor((r["target"] - rounds * r["source_size"]) * blocks / r["source_size"] + 0.5)) if r["source_size"] else 0
        if rounds * blocks + rest:
            quotas.append((r["rank"], blocks, rounds * blocks + rest))
    total, taken = sum(q for _, _, q in quotas), dict.fromkeys((r for r, _, _ in quotas), 0)
    slots = []
    for shard in range(-(-total // per_shard)):
        n = min(per_shard, total - shard * per_shard)
        counts = np.random.default_rng([seed, shard, 0]).multinomial(n, np.array([q for _, _, q in quotas]) / total)
        for (rank, _, quota), k in zip(quotas, counts.tolist()):
            slots += [(rank, s) for s in range(taken[rank], min(taken[rank] + k, quota))]
            taken[rank] += k
    for rank, _, quota in quotas:
        slots += [(rank, s) for s in range(taken[rank], quota)]
    return slots, {rank: (blocks, quota) for rank, blocks, quota in quotas}


def test_taken_words_against_the_draws_one_after_another(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(f"w{k}" for k in range(rng.randint(0, 60)))) for i in range(120)]
    rows = [(i, t, "hot" if i % 3 else rng.choice(["a", "b", None])) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(frame, block_words=16, per_shard=32).collect()}
    sources = mixing.source_targets(frame.select("source", mixing.word_count().alias("size"))).collect()
    rank_of = {r["source"]: r["rank"] for r in sources}
    slots, quotas = replayed(sources, 16, 32)
    seeds = spark.createDataFrame([(r, t) for r, (b, q) in quotas.items() for t in range(q // b + 1)], "rank long, turn long").select("rank", "turn", F.xxhash64("rank", "turn", F.lit(mixing.SEED)).alias("h")).collect()
    seed = {(r["rank"], r["turn"]): r["h"] for r in seeds}
    times = {}
    for rank, slot in slots:
        blocks = quotas[rank][0]
        block = int(mixing.permuted(np.array([slot % blocks]), np.array([blocks]), np.array([seed[rank, slot // blocks]]))[0])
        times[rank, block] = times.get((rank, block), 0) + 1
    at = dict.fromkeys(rank_of, 0)
    for i, t, source in sorted(rows, key=lambda r: r[0]):
        n = len(t.split())
        wanted = sum(times.get((rank_of[source], (at[source] + k) // 16), 0) for k in range(n))
        at[source] += n
        assert got[i]["taken"] == wanted, i


def test_permutation_and_shards(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        for seed in (0, -5, 123456789):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, seed))) == list(range(n))
    sizes = spark.createDataFrame([("a", 10_000), ("b", 20_000)], "source string, size long")
    slots = mixing.draw_slots(mixing.source_targets(sizes), block_words=10, per_shard=500)
    assert slots.groupBy("rank").count().orderBy("rank").collect()[0]["count"] == 1000
    by_shard = {r["shard"]: r["count"] for r in slots.groupBy("shard").count().collect()}
    assert sum(by_shard.values()) == 3000 and max(by_shard.values()) <= 500
    assert slots.where("rank = 0").groupBy("block").count().select(F.max("count")).first()[0] == 1
