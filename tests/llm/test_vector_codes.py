import numpy as np
import pytest

from fleetlens.llm import vector_codes as vc

NAN, INF = float("nan"), float("inf")


def lloyd(rows, width, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks, every point against every entry."""
    kept = [(i, lab, [int(np.floor(1024 * float(x))) for x in v] + [0] * (width - len(v))) for i, lab, v in rows]
    points = np.array([v for _, _, v in kept], np.int64).reshape(len(kept), parts, -1)
    first = {}
    for k, (i, _, v) in enumerate(kept):
        if i is not None and (i not in first or v < kept[first[i]][2]):
            first[i] = k
    books = points[[first[i] for i in sorted(first)[:entries]]].transpose(1, 0, 2).copy()
    near = lambda p: ((points[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1)
    for _ in range(rounds):
        for p in range(parts):
            of = near(p)
            for e in set(of.tolist()):
                books[p, e] = points[of == e, p].sum(0) // (of == e).sum()
    codes = np.stack([near(p) for p in range(parts)], 1)
    error = sum(((points[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts)).tolist()
    by = {}
    for (_, lab, _), e in zip(kept, error):
        by[lab] = by.get(lab, 0) + e
    return sorted(((i, lab, "".join(f"{c:02x}" for c in code), e, by[lab]) for (i, lab, _), code, e in zip(kept, codes.tolist(), error)), key=repr), books


def compressed(spark, rows, **how):
    frame = spark.createDataFrame([(i, lab, v, "taken", 1) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, code string, _row int")
    out, books = vc.compress(frame, **how)
    return sorted(map(tuple, out.collect()), key=repr), books


def vectors(n, d, seed, grid=None):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    data = centers[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.2
    return (np.round(data * grid) / grid if grid else data).tolist()


@pytest.mark.parametrize("n,d,grid,leaf", [(1, 3, None, 8), (400, 2, None, 1), (400, 16, None, 8), (300, 3, 2, 4)])
def test_trees_cover_and_assign_exactly(n, d, grid, leaf):
    points = np.floor(1024 * np.array(vectors(n, d, n + d, grid))).astype(np.int64)
    tree = vc.cover_tree(points, leaf)
    assert sorted(tree["order"].tolist()) == list(range(n))
    for at, (a, z) in enumerate(tree["kids"]):
        below = points[tree["order"][tree["begin"][at] : tree["end"][at]]]
        assert np.sqrt(((below - points[tree["center"][at]]) ** 2).sum(1)).max() <= tree["radius"][at] * (1 + 1e-12)
        if z > a:
            assert (tree["begin"][a], tree["end"][z - 1]) == (tree["begin"][at], tree["end"][at]) and (tree["end"][a : z - 1] == tree["begin"][a + 1 : z]).all()
            centers = points[tree["center"][a:z]]
            apart = vc.squared(centers, centers) + np.eye(z - a) * 1e30
            assert apart.min() > tree["radius"][at] ** 2 / 4 * (1 - 1e-12)
    entries = np.concatenate([points[: min(n, 40)], points[: min(n, 5)]])
    label = np.full(n, -1)
    for begins, ends, entry in vc.assign(tree, points, entries):
        for a, z, e in zip(begins, ends, entry):
            assert (label[tree["order"][a:z]] == -1).all()
            label[tree["order"][a:z]] = e
    assert label.tolist() == vc.squared(points, entries).argmin(1).tolist()


def test_clustered_points_are_mostly_assigned_by_subtrees():
    points = np.floor(1024 * np.array(vectors(2000, 4, 3))).astype(np.int64) * 1
    tree = vc.cover_tree(points)
    entries = points[[int(i) for i in np.linspace(0, 1999, 6)]]
    compared = sum(len(b) for b, _, _ in vc.assign(tree, points, entries))
    assert compared < 2000


@pytest.mark.parametrize("size", [7, 2048])
def test_against_every_point_and_entry(spark, monkeypatch, size):
    monkeypatch.setattr(vc.blocks, "__defaults__", (vc.PARTS, size))
    rows = [(i * 3 % 700, i % 5 or None, v) for i, v in enumerate(vectors(700, 8, 5))] + [(1000 + i, 9, [0.25] * 8) for i in range(300)]
    assert compressed(spark, rows)[0] == lloyd(rows, 8)[0]
    assert (compressed(spark, rows)[1] == lloyd(rows, 8)[1]).all()


def test_edges(spark):
    good = [(i, None if i % 2 else 1, v) for i, v in enumerate(vectors(20, 6, 8, 4))]
    odd = [(3, 2, [5.0] * 6), (3, 2, [5.0] * 6), (None, None, [1.0] * 6), (30, 1, [2.0]), (31, 1, []), (-4, 1, [-0.0005] * 6)]
    dropped = [(40, 1, None), (41, 1, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (42, 1, [NAN] * 6), (-50, 1, [INF] + [0.0] * 5), (-51, 1, [-INF] + [0.0] * 5)]
    got, books = compressed(spark, good + odd + dropped)
    wanted, expected = lloyd(good + odd, 8)
    assert got == wanted and books.tolist() == expected.tolist()


def test_nothing_usable(spark):
    assert compressed(spark, [])[0] == [] and compressed(spark, [(1, 1, None), (2, 1, [NAN])])[0] == [] and compressed(spark, [(1, 1, [])])[0] == []
    assert compressed(spark, [(None, 1, [1.0, 2.0])])[0] == []


def test_components_that_are_too_large_say_so(spark):
    with pytest.raises(Exception, match="too large"):
        compressed(spark, [(1, 1, [1e12, 0.0, 0.0, 0.0])])


def test_smallest_ids_behind_many_repeats(spark):
    frame = spark.createDataFrame([(i // 40,) for i in range(400)] + [(None,)], "vec_id long")
    assert vc.smallest_ids(frame, 6) == [0, 1, 2, 3, 4, 5] and vc.smallest_ids(frame, 50) == list(range(10))
