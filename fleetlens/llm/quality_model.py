"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest is grown on a bounded sample of labelled documents; the paths of its trees become
conjunctive rules (``marks_per_word <= 0.2 and distinct_share > 0.4``). A logistic regression with a lasso
penalty weighs the rules, and the few that keep a weight are compiled into one Spark column expression over
the statistics, which are counted once for each text, over its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bytesvec import Words, bytes_of, lines_of, range_hashes, seen_before, sums_between

#: Labelled rows that the rules are fitted on at most (the smallest by a hash of their ids)
FIT_ROWS, TREES, DEPTH, LASSO, THRESHOLD, HELD_OUT = 10_000, 12, 3, 2e-4, 0.3, 5

STATISTICS = ("n_words", "word_length", "marks_per_word", "upper_share", "digit_share", "distinct_share", "echo_share", "copied_lines", "stops_per_word")




def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


MARKS, DIGITS, STOPS = _bytes("#*$%&|<>!@^~=_{}[]\\"), _bytes("0123456789"), _bytes(".?")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def statistics(texts: pa.Array) -> list[np.ndarray]:
    """``STATISTICS`` of whole texts, in that order; all are 0 for a null or empty text.

    Words are runs without white space, characters are code points; capitals are A-Z and those of U+00C0 to U+00DE;
    an echo is a word equal to the one before; lines are those with a word, copied if equal to an earlier one.
    """
    data, offsets = bytes_of(texts)
    words, starts, ends = Words(data, offsets), offsets[:-1], offsets[1:]
    hashes, n_words = words.hashes(), words.counts()
    owner = np.repeat(np.arange(len(texts)), n_words)
    upper = UPPER[data]
    upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    chars = sums_between((data < 0x80) | (data >= 0xC0), starts, ends)
    times = lambda items: np.bincount(items, minlength=len(texts))
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    of_line, first, last, _, _ = lines_of(data, offsets, words)
    copied = seen_before(of_line, range_hashes(data, first, last))
    per_word, per_char = 1.0 / np.maximum(n_words, 1), 1.0 / np.maximum(chars, 1)
    count = lambda kind: sums_between(kind[data], starts, ends)
    return [
        n_words.astype(float),
        chars * per_word,
        count(MARKS) * per_word,
        sums_between(upper, starts, ends) * per_char,
        count(DIGITS) * per_char,
        times(owner[~seen_before(owner, hashes)]) * per_word,
        times(owner[echo]) * per_word,
        times(of_line[copied]) / np.maximum(times(of_line), 1),
        count(STOPS) * per_word,
    ]


def with_statistics(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    fields = [T.StructField(n, T.DoubleType()) for n in STATISTICS]
    return common.with_batch_columns(docs, "text", fields, lambda: lambda texts: [pa.array(x) for x in statistics(texts)], drop)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.name) > self.bound if self.above else F.col(self.name) <= self.bound


@dataclass
class RuleModel:
    """Weights of rules, each a set of conditions that hold together, and the intercept."""

    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            total = total + F.when(_all(conditions), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _all(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def rules_of(roots: list, names: tuple[str, ...]) -> list[tuple[Condition, ...]]:
    """Every path from one of the fitted trees' ``roots`` to a leaf or inner node, each once, tightest bounds only."""
    found: dict[tuple[Condition, ...], None] = {}

    def walk(node, path: tuple[Condition, ...]) -> None:
        if path:
            tight: dict[tuple[str, bool], Condition] = {}
            for c in path:
                key = (c.name, c.above)
                if key not in tight or (c.bound > tight[key].bound) == c.above:
                    tight[key] = c
            found[tuple(sorted(tight.values(), key=lambda c: (c.name, c.above)))] = None
        if node.subtreeDepth() > 0:
            split = node.split()
            name, bound = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, Condition(name, False, bound)))
            walk(node.rightChild(), (*path, Condition(name, True, bound)))

    for root in roots:
        walk(root, ())
    return list(found)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """Learn from at most ``rows`` labelled rows whose crc32(doc_id) mod 5 is not 0; only the text is an input.

    Labels other than 0 and 1 and null ids teach nothing; of conflicting labels of an id the larger counts.
    Without labels the score is 0.5, with labels of one class that class's 0.01 or 0.99.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    sample = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ("text",))
    sample = common.materialize(sample, "quality-sample").coalesce(4).sortWithinPartitions("doc_id")
    classes = [r[0] for r in sample.select("quality").distinct().collect()]
    if len(classes) < 2:
        return RuleModel([], 0.0 if not classes else 4.6 if classes[0] else -4.6)
    ready = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(sample)
    forest = RandomForestClassifier(labelCol="quality", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed).fit(ready)
    rules = rules_of([tree._call_java("rootNode") for tree in forest.trees], STATISTICS)
    held = sample.select("quality", *(_all(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    ready = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held)
    model = LogisticRegression(labelCol="quality", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(ready)
    return RuleModel([(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist()) if w], model.intercept)


def score_documents(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on).

    Every row is scored by its whole text alone, so ties and repeated rows score alike; a null or empty text has all
    statistics 0 and the score that the rules give those. Columns with the names of the result or of the statistics
    are replaced, columns named in ``drop`` left out. An empty table stays empty. Texts are read in slices of about a
    megabyte; a longer text is a slice of its own, and needs some 20 bytes of memory a byte.
    """
    scored = with_statistics(common.drop_clashing(docs, ["score", "predicted"]), drop).withColumn("score", model.score()).drop(*STATISTICS)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score_documents(docs, model, drop=("text",)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
