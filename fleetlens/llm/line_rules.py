"""Quality rules with line sequence labelling.

A linear-chain conditional random field with two states, boilerplate (0) and content (1), reads a few
shares computed from each line. Viterbi decoding labels all lines of a document together; the document
stays if at least half of its words stand in content lines, and if it passes two plain rules (20 words or
more; at most 30 % of the words in 8-word passages that repeat within the document).

The field learns from lines. Those of labelled documents count as boilerplate where they show it (symbols,
capitals, numbers, echoes, copies of earlier lines, navigation) and as content elsewhere; a document of bad
quality none of whose lines shows anything is boilerplate as a whole. So weights, and how often a label
changes from line to line, come from both kinds of documents and from those that mix the two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bytesvec import Words, bytes_of, lines_of, mix, range_hashes, seen_before, sums_between, windows

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH, MIN_CONTENT = 20, 30, 8, 0.5
#: Labelled documents that the field is fitted on at most, and the lines of a chain into which fitting cuts their lines.
FIT_DOCUMENTS, CHAIN_LINES = 1500, 128

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "#*$%&|<>!@^~=_{}[]\\/+"]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC3, 0xF5)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True
FEATURES = ("bias", "marks", "upper", "digits", "repeats", "copied", "short", "stops")


@dataclass
class Field:
    """Weights of the features for the state content, and transition scores [from, to]."""

    weights: np.ndarray
    moves: np.ndarray

    @classmethod
    def all_content(cls) -> Field:
        """What stands in where there are no labels to learn from: every line is content."""
        return cls(np.eye(1, len(FEATURES))[0] * 5.0, np.zeros((2, 2)))


def line_table(data: np.ndarray, offsets: np.ndarray, words: Words, hashes: np.ndarray):
    """Lines (split at \\n) that hold a word: their text's number, words, features and whether an earlier one is equal."""
    text, starts, ends, lo, hi = lines_of(data, offsets, words)
    count = np.maximum(hi - lo, 1)
    copied = seen_before(text, range_hashes(data, starts, ends))
    letters = np.maximum(sums_between(LETTER[data], starts, ends), 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    last_byte = data[words.ends[hi - 1] - 1] if len(hi) else np.zeros(0, np.uint8)
    features = np.stack(
        [
            np.ones(len(starts)),
            np.minimum(sums_between(MARKS[data], starts, ends) / count, 2.0),
            sums_between(UPPER[data], starts, ends) / letters,
            sums_between(DIGIT[data], starts, ends) / letters.clip(1),
            sums_between(again, lo, hi) / count,
            copied.astype(float),
            (count < 4).astype(float),
            ((last_byte == ord(".")) | (last_byte == ord("?")) | (last_byte == ord("!"))).astype(float),
        ],
        axis=1,
    )
    features[:, 3] = np.minimum(features[:, 3], 2.0)
    return text, count, features, copied


def viterbi(emissions: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest labels of all chains at once; chain i has rows bounds[i] to bounds[i + 1]. Ties go to content."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    sizes, begins = sizes[order], bounds[:-1][order]
    best = np.zeros((len(sizes), 2))
    back = np.zeros((len(emissions), 2), np.int8)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    for t in range(longest):
        n = alive[t]
        rows = begins[:n] + t
        if t:
            paths = best[:n, :, None] + moves
            back[rows] = came = (paths[:, 1] >= paths[:, 0]).astype(np.int8)
            best[:n] = np.where(came, paths[:, 1], paths[:, 0]) + emissions[rows]
        else:
            best[:n] = emissions[rows]
    labels = np.zeros(len(emissions), np.int8)
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        rows = begins[: alive[t]] + t
        labels[rows] = state[: alive[t]]
        if t:
            state[: alive[t]] = back[rows, state[: alive[t]]]
    return labels


def shows_boilerplate(features: np.ndarray) -> np.ndarray:
    """Lines of symbols, capitals, numbers or echoes, copies of earlier lines, and navigation: short, and without a stop."""
    marks, upper, digits, repeats, copied, short, stops = features[:, 1:].T
    return (marks > 0.3) | (upper > 0.5) | (digits > 0.5) | (repeats > 0.3) | (copied > 0) | ((short > 0) & (stops == 0))


def line_labels(features: np.ndarray, quality: int) -> np.ndarray:
    """What each line of a labelled document teaches: 0 for boilerplate, 1 for content."""
    bad = shows_boilerplate(features)
    if quality == 0 and not bad.any():
        bad[:] = True
    return (~bad).astype(int)


def fit_field(documents: list[np.ndarray], qualities: list[int], steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps over the lines of labelled documents, the two qualities weighing the same.

    Long documents are cut into chains of ``CHAIN_LINES`` lines, all of which are read.
    """
    labels = [line_labels(x, q) for x, q in zip(documents, qualities)]
    if len({y for of in labels for y in of.tolist()}) < 2:
        return Field.all_content()
    chains = [(i, at) for i, x in enumerate(documents) for at in range(0, len(x), CHAIN_LINES)]
    n, longest = len(chains), min(CHAIN_LINES, max(map(len, documents)))
    x, alive, y = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest)), np.zeros((n, longest), int)
    share = np.zeros((n, 1))
    for c, (i, at) in enumerate(chains):
        f = documents[i][at : at + CHAIN_LINES]
        x[c, : len(f)], alive[c, : len(f)], y[c, : len(f)] = f, 1, labels[i][at : at + CHAIN_LINES]
        share[c] = 0.5 / qualities.count(qualities[i]) / len(documents[i])
    follows = alive[:, 1:, None] * np.eye(4)[2 * y[:, :-1] + y[:, 1:]]
    seen = (follows * share[:, None]).sum((0, 1)).reshape(2, 2)
    params = np.zeros(len(FEATURES) + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        weights, moves = params[: len(FEATURES)], params[len(FEATURES) :].reshape(2, 2)
        score = np.stack([np.zeros((n, longest)), x @ weights], 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            grown = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + score[:, t]
            forward[:, t] = np.where(alive[:, t, None] > 0, grown, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        pairs = np.zeros((n, 2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            shrunk = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            on = alive[:, t + 1, None]
            backward[:, t] = np.where(on > 0, shrunk, 0)
            pairs += np.exp(forward[:, t, :, None] + moves + ahead[:, None, :] - total[:, None, None]) * on[..., None]
        content = np.exp(forward[..., 1] + backward[..., 1] - total[:, None]) * alive
        wanted = (y - content) * alive * share
        slope = np.concatenate([np.einsum("nt,ntf->f", wanted, x), (seen - (pairs * share[:, :, None]).sum(0)).ravel()]) - decay * params
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        params += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(params[: len(FEATURES)], params[len(FEATURES) :].reshape(2, 2))


def field_from_labels(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> Field:
    """Fit on at most ``documents`` labelled documents, chosen by a hash of their ids (crc32 of the id mod 5 not 0).

    Labels other than 0 and 1 and null ids teach nothing, nor do documents without words; of conflicting labels of
    an id the larger counts.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            data, offsets = bytes_of(texts)
            words = Words(data, offsets)
            text, _, features, _ = line_table(data, offsets, words, words.hashes())
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            return [pa.array([features[a:b].astype(np.float32).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())]

        return compute

    sample = common.with_batch_columns(rows, "text", [T.StructField("lines", T.BinaryType())], make, ("text",)).orderBy("doc_id").collect()
    sample = [(np.frombuffer(r["lines"], np.float32).reshape(-1, len(FEATURES)).astype(float), r["quality"]) for r in sample if r["lines"]]
    return fit_field([x for x, _ in sample], [y for _, y in sample])


MEASURES = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines")),
    T.StructField("content_share", T.DoubleType()),
    T.StructField("line_labels", T.ArrayType(T.ByteType())),
]


def label_lines(docs: DataFrame, field: Field, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the measures of each whole text and the labels of its lines (those with a word, in order).

    A null or empty text has no words and no lines and a content share of 0. Every row is measured by
    itself; columns with the names of the measures are replaced.
    """

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            data, offsets = bytes_of(texts)
            n = len(texts)
            words = Words(data, offsets)
            hashes, n_words = words.hashes(), words.counts()
            starts, ends = offsets[:-1], offsets[1:]
            passages, bounds = windows(hashes, words.bounds, REPEAT_WIDTH)
            owner = np.repeat(np.arange(n), np.diff(bounds))
            keys = mix(passages ^ mix(owner.astype(np.uint64)))
            _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(times[which] > 1) if len(keys) else np.zeros(0, np.int64)
            at = words.bounds[:-1][owner[twice]] + twice - bounds[:-1][owner[twice]]
            cover = np.zeros(len(hashes) + REPEAT_WIDTH + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT_WIDTH, -1)
            covered = np.cumsum(cover)[: len(hashes)] > 0
            line_text, line_words, features, copied = line_table(data, offsets, words, hashes)
            line_bounds = np.searchsorted(line_text, np.arange(n + 1))
            emissions = np.zeros((len(features), 2))
            emissions[:, 1] = features @ field.weights
            labels = viterbi(emissions, line_bounds, field.moves)
            a, b = line_bounds[:-1], line_bounds[1:]
            share = sums_between(line_words * labels, a, b) / np.maximum(n_words, 1)
            longs = [n_words, sums_between(~words.space & ~CONTINUES[data], starts, ends), sums_between(SYMBOLS[data], starts, ends), sums_between(copied, a, b), sums_between(covered, words.bounds[:-1], words.bounds[1:]), b - a, sums_between(labels, a, b)]
            return [*(pa.array(np.asarray(x, np.int64)) for x in longs), pa.array(share.astype(float)), pa.ListArray.from_arrays(pa.array(line_bounds.astype(np.int32)), pa.array(labels))]

        return compute

    return common.with_batch_columns(docs, text, MEASURES, make, drop)


def with_verdict(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return common.drop_clashing(measured, ["base_failed", "kept"]).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= MIN_CONTENT))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdict."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    field = field_from_labels(docs, common.table(spark, sf_dir, "labels"))
    return with_verdict(label_lines(docs, field, drop=("text",))).drop("line_labels")
