import random
import re

import numpy as np
import pyarrow as pa

from fleetlens.llm import common, near_dedup
from .conftest import SMALL

SCHEMA = "doc_id long, text string, component_id string"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_force(rows):
    sets = {i: sets_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    shared = len(sets[a] & sets[b])
                    if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def assert_same(spark, rows):
    frame = spark.createDataFrame([(i, t, "taken") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame).collect()}
    wanted = brute_force(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == wanted
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_groups_chains_and_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  Two"), (8, "two one"), (9, "a b c d"), (10, "a b c d e"), (11, "a b c d e a b c d e")]
    at = 20
    for _ in range(15):  # near copies of a text, and chains of edits that end far from their beginning
        base = [word() for _ in range(rng.randint(30, 120))]
        passage = ["the", "same", "passage", "stands", "here"] * 2
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((at, " ".join(copy + passage)))
            at += rng.randint(1, 3)
            if rng.random() < 0.5:
                base = copy
    rng.shuffle(rows)
    assert_same(spark, rows)


def test_table_of_documents(spark):
    assert_same(spark, [(r["doc_id"], r["text"]) for r in common.table(spark, SMALL.replace("sf0.001", "sf0.01"), "documents").collect()])


def test_nulls_repeats_and_no_rows(spark):
    text = "some words that are the same in every row of it"
    frame = spark.createDataFrame([(None, text, ""), (3, text, ""), (3, text, ""), (None, None, "")], SCHEMA)
    rows = sorted(near_dedup.near_duplicates(frame).collect(), key=str)
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows] == [(3, 7, 3), (3, 7, 3), (None, 0, None), (None, 7, 3)]
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_keys_agree_as_often_as_the_sets_are_alike():
    rates = []
    for seed in range(1, 41):
        words = [f"w{i}" for i in np.random.default_rng(seed).permutation(4000)]
        _, _, a, b = near_dedup.signature(pa.array([" ".join(words[:2000]), " ".join(words[100:2100])]))  # 1896 of 2096 shared
        same = sum(x == y for side in (a, b) for x, y in zip(*side.to_pylist()))
        rates.append(same / (2 * near_dedup.GROUPS))
    # 40 x 28 keys of two minima each: a standard deviation of about 0.012
    assert abs(np.mean(rates) - (1896 / 2096) ** near_dedup.PER_GROUP) < 0.036


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 40), (50, 50)], "u long, v long")
    got = dict(near_dedup.components(links).collect())
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 41: 40, 50: 50}


def test_links_across_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE_MEMBERS", (60, 90))
    monkeypatch.setattr(near_dedup, "TILE_CELLS", 200)
    rng = random.Random(7)
    sets = {}
    for i in range(12):  # pairs that share members of their own besides those of the whole group
        own = {1000 * i + k for k in range(14)}
        for side in "xy":
            sets[f"{side}{i}".encode()] = set(rng.sample(range(30), 22)) | own | {1000 * i + 100 + ord(side)}
    sets |= {f"m{i}".encode(): set(range(30)) - {i} for i in range(8)}
    label = {k: b"main" if k[:1] == b"m" else k for k in sets}
    left = spark.createDataFrame([(bytearray(k), bytearray(label[k]), len(s), 1) for k, s in sets.items()], "set_key binary, label binary, size long, key long")
    held = spark.createDataFrame([(bytearray(k), sorted(s)) for k, s in sets.items()], "set_key binary, members array<long>")
    got = {frozenset((bytes(r["u"]), bytes(r["v"]))) for r in near_dedup.tile_links(left, held, 75).collect()}
    wanted = {frozenset((a, b)) for a in sets for b in sets if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(wanted) > 4 and got == wanted
