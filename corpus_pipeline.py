"""The corpus pipeline: documents in, the mix's token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, common, line_rules, mixing, near_dedup, quality_model


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, all columns as they are.

    Every row is judged by its whole text alone, however long, so ties and repeated rows meet the same fate; a null or empty text
    has all statistics 0 and stays or goes by the rules for those. Ids that are null have no label but are
    judged like others. Columns may have any names. An empty table stays empty.
    """
    model = quality_model.fit(docs, common.table(spark, sf_dir, "labels"))
    judged = quality_model.score_documents(common.packed(docs, "text"), model)
    return common.unpacked(judged.where("predicted = 1"), docs.columns, "text")


def keep_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and hold content in at least half of their words, all columns as they are.

    Every row is judged by its whole text alone, however long, so ties and repeated rows meet the same fate; a null or empty text has
    no words and goes. Null ids are judged like others. Columns may have any names. An empty table stays empty.
    """
    field = line_rules.field_from_labels(docs, common.table(spark, sf_dir, "labels"))
    judged = line_rules.with_verdict(line_rules.label_lines(common.packed(docs, "text"), field))
    return common.unpacked(judged.where("kept"), docs.columns, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id (null last), all columns as they are.

    Whole texts are compared, however long. Of rows that repeat id and text one stays; ties of ids go by a hash of the text. Texts that
    are null or without words are like no other and all stay. Columns may have any names. An empty table stays empty.
    """
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the mix takes, as rows of the documents that they are of; but for the text, all columns as they are.

    A null source is the last source. Rows that repeat an id, or have none, are documents like any other, and
    tied ones stand in the order of their sizes and places. Texts without words are never taken; a long one is taken by its
    blocks. Columns may have any names. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, ids_sha256, decoded_sha256 of every row of the mix.

    Every row is encoded by itself, its whole text, however long, so repeated rows and ties give equal rows; a null or empty text has no
    ids and the digests of the empty string. Null ids and sources stay null; other columns are not returned. An empty
    table gives an empty result.
    """
    both = bpe.encode(docs.select("doc_id", "source", common.text_or_empty().alias("text")), drop=("text",), decoded="decoded")
    return both.select(
        "doc_id",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_good_quality),
    ("quality rules", keep_content),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: Fitted models, hashes and permutations are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each but the last returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
