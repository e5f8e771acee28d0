import math
import re

import pytest

from fleetlens.llm import common, quality_model
from .conftest import EDGES, SMALL


def test_held_out_accuracy(spark):
    sf = SMALL.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    rows = quality_model.op1_quality_classifier(spark, sf).collect()
    assert len(rows) == common.table(spark, sf, "documents").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 300 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    good = [r for r in held if labels[r["doc_id"]] == 1]
    assert sum(r["predicted"] for r in good) >= 0.99 * len(good)


def test_edges_have_a_score(spark, edge_docs):
    model = quality_model.RuleModel([((quality_model.Condition("n_words", False, 3.0),), -2.0)], 1.0)
    rows = quality_model.score_documents(edge_docs.withColumnRenamed("token_ids", "Score"), model).collect()
    assert len(rows) == len(EDGES) and all(r["score"] is not None for r in rows)
    assert quality_model.score_documents(edge_docs.limit(0), model).count() == 0


def test_no_labels_or_one_class(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.score_documents(edge_docs, quality_model.fit(edge_docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(12)] + [(None, 0), (3, 7)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality_model.score_documents(edge_docs, quality_model.fit(edge_docs, ones)).collect()} == {1}


class Node:
    """A fitted tree's node as Spark shows it; a leaf without arguments."""

    def __init__(self, feature=None, bound=None, left=None, right=None):
        self.feature, self.bound, self.left, self.right = feature, bound, left, right

    def subtreeDepth(self):  # noqa: N802
        return 0 if self.feature is None else 1 + max(self.left.subtreeDepth(), self.right.subtreeDepth())

    def split(self):
        return self

    def featureIndex(self):  # noqa: N802
        return self.feature

    def threshold(self):
        return self.bound

    def leftChild(self):  # noqa: N802
        return self.left

    def rightChild(self):  # noqa: N802
        return self.right


def test_rules_of_trees():
    c = quality_model.Condition
    roots = [Node(0, 2.0, Node(1, 0.5, Node(), Node()), Node()), Node(0, 3.0, Node(0, 2.0, Node(), Node()), Node())]
    rules = quality_model.rules_of(roots, ("a", "b"))
    assert set(rules) == {(c("a", False, 2.0),), (c("a", False, 2.0), c("b", True, 0.5)), (c("a", False, 2.0), c("b", False, 0.5)), (c("a", True, 2.0),), (c("a", False, 3.0),), (c("a", False, 3.0), c("a", True, 2.0)), (c("a", True, 3.0),)}


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = max(1, len(words)), max(1, len(text))
    upper = sum("A" <= x <= "Z" or "\xc0" <= x <= "\xde" and x != "\xd7" for x in text)
    return {
        "n_words": len(words),
        "word_length": len(text) / n,
        "marks_per_word": sum(x in "#*$%&|<>!@^~=_{}[]\\" for x in text) / n,
        "upper_share": upper / chars,
        "digit_share": sum(x in "0123456789" for x in text) / chars,
        "distinct_share": len(set(words)) / n,
        "echo_share": sum(a == b for a, b in zip(words, words[1:])) / n,
        "copied_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "stops_per_word": sum(x in ".?" for x in text) / n,
    }


def plain_score(model, stats):
    total = model.intercept
    for conditions, weight in model.rules:
        if all((stats[c.name] > c.bound) == c.above for c in conditions):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_statistics_and_scores_against_plain_python(spark, edge_docs):
    sf = SMALL.replace("sf0.001", "sf0.01")
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, common.table(spark, sf, "labels"))
    assert model.rules
    for frame in (docs, edge_docs.select("doc_id", "text")):
        stats = {r["doc_id"]: r for r in quality_model.with_statistics(frame).collect()}
        scored = {r["doc_id"]: r for r in quality_model.score_documents(frame, model).collect()}
        for r in frame.collect():
            wanted = plain_statistics(r["text"])
            for name, value in wanted.items():
                assert stats[r["doc_id"]][name] == pytest.approx(value, abs=1e-12), (name, r["text"])
            exact = {name: stats[r["doc_id"]][name] for name in wanted}
            assert scored[r["doc_id"]]["score"] == pytest.approx(plain_score(model, exact), abs=1e-9)
            assert scored[r["doc_id"]]["predicted"] == int(scored[r["doc_id"]]["score"] >= 0.3)
