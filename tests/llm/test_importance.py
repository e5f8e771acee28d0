import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import importance
from .conftest import EDGES

TARGET = ["one two three four", "lead trail", None, "", "wide space"]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_force(docs, target):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((float(t[b] + 1) * float(big_s + 10000)) / (float(s[b] + 1) * float(big_t + 10000))))
    rows = []
    for i, n, found in own:
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[3], r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted((tuple([*r, ranks.get(id(r))]) for r in rows), key=repr)


def drawn(spark, docs, target):
    frame = spark.createDataFrame([(i, t, "taken", "taken") for i, t in docs], "doc_id long, text string, score string, _out string")
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    return sorted(map(tuple, importance.resample(frame, wanted).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 5, 100_000])
def test_ngrams_in_chunks_of_any_size(monkeypatch, size):
    monkeypatch.setattr(importance, "CHUNK_WORDS", size)
    texts = EDGES + ["Hello, big World 2 é日本 x", "Z" * 200 + " b " + "q" * 65 + " zz", "one two  three-four"]
    got = [pair for owner, hits in importance.ngrams(pa.array(texts)) for pair in zip(owner.tolist(), hits.tolist())]
    assert sorted(got) == sorted((i, b) for i, t in enumerate(texts) for b in features(t)[1])


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    parts = [(rng.bytes(rng.integers(0, 300)), rng.bytes(rng.integers(0, 300))) for _ in range(300)]
    crc = lambda k: np.array([crc32(p[k]) for p in parts], np.uint32)
    both = importance.joined_crc(crc(0), crc(1), np.array([len(p[1]) for p in parts]))
    assert both.tolist() == [crc32(a + b) for a, b in parts]


def test_edges_ties_and_repeats(spark):
    texts = EDGES + [" ".join(f"w{(i * 7 + j) % 50}" for j in range(25)) for i in range(60)] + ["one two three four " * 8] * 3
    docs = list(enumerate(texts)) + [(70, texts[70]), (70, texts[70]), (70, texts[71]), (None, texts[72]), (None, None)]
    assert drawn(spark, docs, TARGET) == brute_force(docs, TARGET)
    assert sum(r[5] is not None for r in drawn(spark, docs, TARGET)) >= 3


def test_no_target_and_no_documents(spark):
    docs = [(i, f"a b c {i} " * 10) for i in range(30)]
    assert drawn(spark, docs, []) == brute_force(docs, [])
    assert drawn(spark, [], TARGET) == []


def test_a_text_of_more_than_a_slice(spark):
    docs = [(1, "alpha beta gamma " * 120_000), (2, "alpha beta " * 20), (3, None)]
    assert drawn(spark, docs, TARGET) == brute_force(docs, TARGET)
