import numpy as np

from fleetlens.llm import common, vector_search
from .conftest import SMALL


def brute_force(ids, vectors, nearest=20, every=20):
    out = {}
    for i, v in zip(ids, vectors):
        if i % every == 0:
            scores = [((w * v).sum(), -j) for j, w in zip(ids, vectors) if j != i]
            out[i] = [(-j, s) for s, j in sorted(scores, reverse=True)[:nearest]]
    return out


def found(frame):
    out = {}
    for r in vector_search.search(frame).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    table = common.table(spark, SMALL.replace("sf0.001", "sf0.1"), "embeddings")
    rows = table.collect()
    vectors = np.array([r["embedding"] for r in rows])
    wanted, got = brute_force([r["vec_id"] for r in rows], vectors), found(table)
    assert set(got) == set(wanted)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted]
    assert sum(hits) >= 0.9 * sum(map(len, wanted.values()))
    for q, near in got.items():
        exact = dict(wanted[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in near if i in exact)
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == 20


def test_copies_unusable_vectors_and_norms(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8)) * rng.uniform(0.1, 3, size=(300, 1))
    vectors[100:160] = vectors[40]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(1000, None, ""), (1020, [0.0] * 8, ""), (1040, [float("nan")] + [1.0] * 7, ""), (1060, [None] + [1.0] * 7, ""), (None, [1.0] * 8, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    wanted, got = brute_force(range(300), vectors), found(frame)
    assert set(got) == set(wanted)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted) >= 0.9 * 20 * len(wanted)
    copies = [i for i, _ in got[40] if 100 <= i < 160]  # of equal vectors the smallest ids, without the query's own
    assert copies == list(range(100, 100 + len(copies))) and 100 not in [i for i, _ in got[100]]


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [0.5, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert found(frame) == {0: [(1, 1.0), (20, 0.5)], 20: [(1, 2.5), (0, 0.5)]}
    assert found(frame.limit(0)) == {}


def test_adaptive_scan_keeps_the_nearest_and_abandons_others():
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors, queries = unit(rng.normal(size=(3000, 65))), unit(rng.normal(size=(20, 65)))
    distances = ((vectors[None] - queries[:, None]) ** 2).sum(2)
    bounds = np.sort(distances, axis=1)[:, 40]
    q, v, read = vector_search.adaptive_scan(queries, vectors, bounds, slack=2.5)
    assert read < 0.6 * 20 * vectors.size
    found = set(zip(q.tolist(), v.tolist()))
    assert all(distances[i, j] <= bounds[i] + 1e-6 for i, j in found)
    wanted = {(i, j) for i in range(20) for j in np.argsort(distances[i])[:21].tolist()}
    assert len(wanted - found) <= 0.02 * len(wanted)
    assert len(vector_search.adaptive_scan(queries, vectors, np.full(20, np.inf))[0]) == 60_000


def test_large_and_small_numbers(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 6))
    for factor in (1e150, 1e-150):
        rows = [(i, (v * factor).tolist()) for i, v in enumerate(vectors)]
        wanted, got = brute_force(range(60), vectors * factor), found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in wanted.items()}
    rows = [(i, [x * (1e200 if i % 3 == 0 else 1e-200 if i % 3 == 1 else 1) for x in v.tolist()]) for i, v in enumerate(vectors)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert set(got) == {0, 20, 40} and all(len(near) == 20 for near in got.values())


def test_lists_of_few_vectors_are_not_enough(spark):
    far = np.zeros((200, 4))
    far[:, 0] = np.arange(200) % 100 * 10.0 + 1
    far[:, 1] = np.where(np.arange(200) % 100 < 50, 300.0, -300.0)
    rows = [(i, v.tolist()) for i, v in enumerate(far)] + [(1000, [0.0, 0.0, 1.0, 5000.0])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert all(len(near) == 20 for near in got.values()) and 1000 in got


def test_share_of_dimensions_read(spark):
    table = common.table(spark, SMALL.replace("sf0.001", "sf0.1"), "embeddings")
    reads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    vector_search.search(table, reads=reads).collect()
    assert 0 < reads[0].value < 0.7 * reads[1].value
