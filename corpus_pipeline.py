"""The corpus pipeline: quality, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and but for the last returns the columns of
documents. Rows that share a doc_id, or have none, are distinct documents; of linked ones a single row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import common, decontaminate, line_dedup, ngram_join, packing, quality_crf

#: Encoded pieces that a worker of the last stage keeps: fewer than packing alone does, as workers of earlier stages are still
#: there, idle, with what they have loaded.
PIECES = 200_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the line classifier, trained on these ones' labels, rejects."""
    field = quality_crf.train(docs, common.table(spark, sf_dir, "labels"))
    if field is None:
        return docs.select(*COLUMNS)
    return quality_crf.classify(docs.select(*COLUMNS), field).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted, and documents of which nothing stays; n_chars follows the text."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text_kept").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_removed") > 0
    return out.select(
        "doc_id",
        F.when(changed, F.col("text_kept")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("text_kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (null last) stays, as a single row."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that stay, in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), pieces=PIECES)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("packing", packed)]

#: No stage but the second and the fourth can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
