from collections import Counter
import math
import re

import numpy as np
import pytest

from fleetlens.llm import ngram_lm
from .conftest import EDGES


def brute_force(texts):
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    singles = Counter(w for ws in split for w in ws)
    pairs = Counter(p for ws in split for p in zip([None, *ws], ws))
    befores = {None: sum(1 for ws in split if ws)}
    total = sum(singles.values())
    out = []
    for ws in split:
        score, missed = 0.0, 0
        for before, word in zip([None, *ws], ws):
            if pairs[before, word] >= 2:
                score += math.log(pairs[before, word] / befores.get(before, singles[before]))
            else:
                score += math.log(0.4 * singles[word] / total)
                missed += 1
        out.append((len(ws), missed, score))
    return out


def test_scores(spark, edge_docs):
    texts = EDGES + ["the cat sat", "the cat ran", "The dog sat", "a cat sat"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in ngram_lm.backoff_scores(docs).collect()}
    assert len(got) == len(texts)
    for i, (n, missed, score) in enumerate(brute_force(texts)):
        assert (got[i]["n_words"], got[i]["n_backed_off"]) == (n, missed)
        assert got[i]["log_score"] == pytest.approx(score, abs=1e-9)
        assert got[i]["mean_log_score"] == pytest.approx(score / n if n else 0, abs=1e-9)
    assert ngram_lm.backoff_scores(docs.limit(0)).count() == 0


def test_words_beyond_the_vocabulary_are_one(spark):
    docs = spark.createDataFrame([(1, "a a a b c"), (2, "a b d"), (None, "x"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_lm.backoff_scores(docs, most_words=1).collect()}
    renamed = brute_force(["a a a u u", "a u u", "u"])
    assert got[1]["log_score"] == pytest.approx(renamed[0][2]) and got[2]["log_score"] == pytest.approx(renamed[1][2]) and got[None]["log_score"] == pytest.approx(renamed[2][2])


@pytest.mark.parametrize("broadcast", [0, 2])
def test_words_that_are_not_broadcast_count_as_themselves(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ngram_lm, "MOST_WORDS", broadcast)
    texts = ["a a a b c", "a b d d e", "x y", "q c d e", "x y z", "", "a a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_lm.backoff_scores(docs).collect()}
    for i, (n, missed, score) in enumerate(brute_force(texts)):
        assert (got[i]["n_words"], got[i]["n_backed_off"]) == (n, missed)
        assert got[i]["log_score"] == pytest.approx(score, abs=1e-9)


def test_pairs_as_numbers_and_back(spark):
    high = (1 << 62) + 5
    words = [0, 1, 77, ngram_lm.SPAN - 1, high, high + 2, (1 << 63) - 1]
    given = [(a, b) for a in words for b in words]
    pair, more = ngram_lm.as_numbers(*np.array(given).T)
    assert len(set(zip(pair.tolist(), more.tolist()))) == len(given)
    frame = spark.createDataFrame(list(zip(pair.tolist(), more.tolist(), range(len(given)))), "pair long, more long, i int")
    before, word = ngram_lm.from_numbers(frame.pair, frame.more)
    assert [tuple(r) for r in frame.orderBy("i").select(before, word).collect()] == given


def test_many_words(spark, monkeypatch):
    """More distinct words than are broadcast, each counting as itself."""
    monkeypatch.setattr(ngram_lm, "MOST_WORDS", 70_000)
    n = ngram_lm.MOST_WORDS + 3000
    rows = [(i, " ".join(f"w{(i * 997 + k * k) % n}" for k in range(400))) for i in range(1500)] + [(5000 + i, f"tail{i} w7 tail{i}") for i in range(n // 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in ngram_lm.backoff_scores(docs).collect()}
    for (i, _), (words, missed, score) in zip(rows, brute_force([t for _, t in rows])):
        assert (got[i]["n_words"], got[i]["n_backed_off"]) == (words, missed)
        assert got[i]["log_score"] == pytest.approx(score, abs=1e-6)
