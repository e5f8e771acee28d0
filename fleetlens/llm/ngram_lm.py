"""Language-model scores by stupid backoff, computed relationally.

Every word of the corpus counts as itself, by its hash, at every size. Pairs of neighbouring words are
counted over all documents, and each document's pairs are exploded and meet their counts:

    S(word | before) = count(before, word) / count(before)    if the pair was seen twice or more,
                       0.4 * count(word) / all words          otherwise,

and the logarithms are summed per document. The scored texts are the corpus itself, so a pair that was seen
once was seen in the text being scored, which is no evidence for it: that is why two are asked for
(``LEAST_COUNT``).

A score is a sum over words, of log(0.4 * count(word) / all words), and over known pairs, of what a pair adds
to that. Both are joined by how frequent the words are:

- pairs of the ``HEAD`` most frequent words (at most ``HEAD ** 2`` and thus few) are counted before any shuffle
  and their scores are broadcast, so a pair that a third of all documents hold is never shuffled;
- any other pair is seen at most all words / ``HEAD`` times. These are dealt out by the hash of the pair, and
  what occurs once goes no further;
- counts of the ``MOST_WORDS`` most frequent words are broadcast, those of all others are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bytesvec import LOWER, U, Words, bytes_of

#: Words whose counts are broadcast: they have numbers by falling count, UNKNOWN and START follow them; others go by their hash.
MOST_WORDS, SPAN = (1 << 19) - 2, 1 << 19
#: Of these, the words whose pairs are broadcast, with UNKNOWN and START.
HEAD = 2046
BACKOFF, LEAST_COUNT = 0.4, 2


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, none of them a number below ``SPAN`` and none negative, and where each text's begin."""
    data, offsets = bytes_of(texts)
    words = Words(LOWER[data], offsets)
    return (words.hashes() >> U(1)) | (U(1) << U(62)), words.bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the corpus by its hash, counted within each slice of texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, batch.column("text")):
                words, times = np.unique(_word_hashes(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words by falling count, and the counts of all numbers."""

    def __init__(self, counts: DataFrame, starts: int, most: int = MOST_WORDS, merge: bool = False):
        # The least count above which there are at most so many words: from how many words have each count, so
        # no task sorts all words and no more than the vocabulary comes to the driver
        sizes = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", F.sum("words").over(Window.orderBy(F.desc("n"))))
        least = sizes.where(F.col("above") <= most).agg(F.min("n")).first()[0]
        top = (counts.where(F.col("n") >= least) if least is not None else counts.limit(0)).toArrow()
        hashes, n = top["word"].to_numpy().astype(np.int64), top["n"].to_numpy().astype(np.int64)
        rank = np.lexsort((hashes, -n))
        hashes, n = hashes[rank], n[rank]
        self.size, self.merge = len(n), merge
        self.total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        #: Counts of every number, UNKNOWN and START included
        self.singles = np.ones(SPAN)
        self.singles[: self.size] = n
        self.singles[SPAN - 2 :] = max(1, self.total - int(n.sum())), max(1, starts)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """A word's number, otherwise its hash, or UNKNOWN if others are to merge."""
        words = words.view(np.int64)
        others = np.full(len(words), SPAN - 2) if self.merge else words
        if not len(self.hashes):
            return others
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.order[at], others)

    def neighbours(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(text, before, word) of all words; before the first word of a text stands START."""
        hashes, bounds = _word_hashes(texts)
        words = self.numbers(hashes)
        before = np.concatenate([[SPAN - 1], words[:-1]]) if len(words) else words
        before[bounds[:-1][np.diff(bounds) > 0]] = SPAN - 1
        return np.repeat(np.arange(len(texts)), np.diff(bounds)), before, words


def in_head(number: np.ndarray) -> np.ndarray:
    return (number < HEAD) | ((number >= SPAN - 2) & (number < SPAN))


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal rows, and how often each occurs; rows are ordered by the first key, then the second."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def as_numbers(before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both words in one number if they have numbers; otherwise a hash, and in ``more`` the other hash, or the other's number and its side."""
    numbered, other = (before < SPAN) & (word < SPAN), word < SPAN
    pair = np.where(numbered, before * SPAN + word, np.where(before >= SPAN, before, word))
    more = np.where(numbered, 0, np.where(other, 2 * word + 1, np.where(before >= SPAN, word, 2 * before + 2)))
    return pair, more


def from_numbers(pair: Column, more: Column) -> tuple[Column, Column]:
    """The words (before, word) of ``as_numbers``."""
    bits = SPAN.bit_length() - 1
    other = F.shiftright(more - 1, 1)
    hashed = more >= 1 << 62
    before = F.when(more == 0, F.shiftright(pair, bits)).when(hashed | (more % 2 == 1), pair).otherwise(other)
    word = F.when(more == 0, pair.bitwiseAND(SPAN - 1)).when(hashed, more).when(more % 2 == 1, other).otherwise(pair)
    return before, word


def _head_pairs(texts: DataFrame, vocabulary, least: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of head words that were seen ``least`` times or more, and what each adds to a score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, batch.column("text")):
                _, before, words = vocabulary.value.neighbours(part.column("text"))
                both = in_head(before) & in_head(words)
                codes, n = np.unique(before[both] * SPAN + words[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    counted = texts.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= least).toArrow().sort_by("code")  # at most (HEAD + 2) ** 2
    codes, n, singles = found["code"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(float), vocabulary.value.singles
    return codes, np.log(n / singles[codes // SPAN]) - np.log(backoff * singles[codes % SPAN] / max(1, vocabulary.value.total))


def backoff_scores(docs: DataFrame, most_words: int | None = None, least: int = LEAST_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """One row per doc_id of ``docs`` (doc_id, text): doc_id, n_words, n_backed_off, log_score, mean_log_score.

    Words are runs without white space, A-Z lower-cased; ``n_backed_off`` counts those whose pair was seen less
    than ``least`` times. With ``most_words``, all but the most frequent words are one. Rows that repeat a
    doc_id (or have none) are scored as one document, each text from its own start. Null and empty texts have no words
    and scores of 0. Other columns are not returned; an empty table gives an empty result. Texts are read in slices
    of about a megabyte; a longer text is a slice of its own, and needs some 20 bytes of memory a byte.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    texts = docs.select("doc_id", "text")
    counts = common.materialize(word_counts(texts), "word-counts")
    starts = texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count()
    merge = most_words is not None
    vocabulary = spark.sparkContext.broadcast(Vocabulary(counts, starts, min(most_words, MOST_WORDS) if merge else MOST_WORDS, merge))
    head = spark.sparkContext.broadcast(_head_pairs(texts, vocabulary, least, backoff))
    total = float(max(1, vocabulary.value.total))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what is known of it here, and one for each of its words that has no number."""
        for batch in batches:
            for part in common.slices(batch, batch.column("text")):
                known, (codes, gains) = vocabulary.value, head.value
                owner, before, words = known.neighbours(part.column("text"))
                n = len(part)
                numbered = words < SPAN
                score = np.bincount(owner[numbered], np.log(backoff * known.singles[words[numbered]] / total), n)
                pairs = before * SPAN + words
                both = in_head(before) & in_head(words)
                at = np.minimum(np.searchsorted(codes, pairs[both]), max(0, len(codes) - 1))
                hit = codes[at] == pairs[both] if len(codes) else np.zeros(len(at), bool)
                score += np.bincount(owner[both][hit], gains[at[hit]], n)
                seen = np.bincount(owner[both][hit], minlength=n)
                rare, times = _distinct(owner[~numbered], words[~numbered])
                of = np.append(np.arange(n), owner[~numbered][rare])
                fill = lambda values, rest: pa.array(np.append(values, np.full(len(rare), rest)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(of)),
                        fill(np.bincount(owner, minlength=n), 0),
                        fill(seen, 0),
                        fill(score, 0.0),
                        pa.array(np.append(np.zeros(n, np.int64), words[~numbered][rare]), mask=np.arange(n + len(rare)) < n),
                        pa.array(np.append(np.zeros(n, np.int64), times).astype(np.int64)),
                    ],
                    names=["doc_id", "n_words", "n_known", "score", "rare", "times"],
                )

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's distinct pairs beyond the head, as two numbers that both words can be read from."""
        for batch in batches:
            for part in common.slices(batch, batch.column("text")):
                owner, before, words = vocabulary.value.neighbours(part.column("text"))
                tail = ~(in_head(before) & in_head(words))
                owner = owner[tail]
                pair, more = as_numbers(before[tail], words[tail])
                at, times = _distinct(pair, more, owner)  # neighbouring rows have alike bytes, so they shuffle in a quarter less
                yield pa.RecordBatch.from_arrays([pa.array(pair[at]), part.column("doc_id").take(pa.array(owner[at])), pa.array(more[at]), pa.array(times.astype(np.int32))], names=["pair", "doc_id", "more", "times"])

    alone = common.materialize(texts.mapInArrow(single, "doc_id long, n_words long, n_known long, score double, rare long, times long"), "words")
    exploded = texts.mapInArrow(explode, "pair long, doc_id long, more long, times int")
    seen = F.sum("times").over(Window.partitionBy("pair", "more"))  # at most all words / HEAD rows of a pair
    known = exploded.withColumn("n", seen).where(F.col("n") >= least)
    before, word = from_numbers(F.col("pair"), F.col("more"))
    numbers = np.append(np.arange(vocabulary.value.size), [SPAN - 2, SPAN - 1])
    singles = spark.createDataFrame(pa.table({"number": numbers, "log_single": np.log(vocabulary.value.singles[numbers])}))
    of = lambda name: F.broadcast(singles.select(F.col("number").alias(f"is_{name}"), F.col("log_single").alias(f"log_{name}")))
    share = float(np.log(backoff / total))
    known = known.select("doc_id", "times", "n", before.alias("before"), word.alias("word"))
    known = known.join(of("before"), F.col("before") == F.col("is_before"), "left").join(of("word"), F.col("word") == F.col("is_word"), "left")
    # What a pair adds, as far as its words' counts are at hand: the others are owed
    gain = F.log("n") - share - F.coalesce("log_before", F.lit(0.0)) - F.coalesce("log_word", F.lit(0.0))
    owed = lambda name: F.when(F.col(f"log_{name}").isNull(), F.col(name))
    known = known.groupBy("doc_id", owed("before").alias("owed_before"), owed("word").alias("owed_word")).agg(F.sum("times").alias("n_known"), F.sum(F.col("times") * gain).alias("score"))
    known = common.materialize(known, "pairs")

    def part(frame: DataFrame, score: Column, n_words: Column = F.lit(0), n_known: Column = F.lit(0)) -> DataFrame:  # noqa: B008
        return frame.select("doc_id", n_words.cast("long").alias("n_words"), n_known.cast("long").alias("n_known"), score.alias("score"))

    debts = alone.where("rare IS NOT NULL").select("doc_id", F.col("rare").alias("owed"), "times", (F.col("times") * share).alias("plain"))
    for name in ("before", "word"):
        owing = known.where(F.col(f"owed_{name}").isNotNull()).select("doc_id", F.col(f"owed_{name}").alias("owed"), (-F.col("n_known")).alias("times"), F.lit(0.0).alias("plain"))
        debts = debts.unionByName(owing)
    debts = debts.groupBy("doc_id", "owed").agg(F.sum("times").alias("times"), F.sum("plain").alias("plain"))
    paid = debts.join(counts, debts.owed == counts.word)
    parts = (
        part(alone.where("rare IS NULL"), F.col("score"), F.col("n_words"), F.col("n_known"))
        .unionByName(part(known, F.col("score"), n_known=F.col("n_known")))
        .unionByName(part(paid, F.col("plain") + F.col("times") * F.log("n")))
    )
    summed = parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), (F.sum("n_words") - F.sum("n_known")).alias("n_backed_off"), F.sum("score").alias("log_score"))
    return summed.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))


def op7_backoff_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's score under the corpus's own pairs."""
    return backoff_scores(common.table(spark, sf_dir, "documents"))
