"""A pipeline over documents: quality classifier, quality rules, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm.jaccard import jaccard_components
from punctual.llm.packing import pack_texts
from punctual.llm.quality import grade_texts, labelled_sample, learn_grades
from punctual.llm.rules import repetition
from punctual.llm.substrings import deduplicate_substrings
from punctual.session import written

SENT_IDS = 1 << 21  # ids of near copies that are sent to all executors; of more, the documents are moved to them


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is high enough stay. The model learns from those of them that are labelled."""
    model = learn_grades(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return grade_texts(docs, model).where("kept").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules pass stay."""
    return repetition(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their five-word shingles. The document with the least doc_id of each group stays, once if its row is repeated; so do rows without a doc_id."""
    equal = F.count_if(F.col("doc_id") == F.col("component_id"))
    other = jaccard_components(docs, percent=80, size=5).groupBy("doc_id").agg(equal.alias("_rows")).where("doc_id is not null and _rows <> 1")
    other = written(other, "other-ids")  # ids that go, or whose rows stay once
    if other.count() <= SENT_IDS:
        other = F.broadcast(other)
    once = docs.join(other, "doc_id", "left_anti")
    more = docs.join(other.where("_rows > 1"), "doc_id", "left_semi").dropDuplicates()
    return once.unionByName(more).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that stand elsewhere before; n_chars is counted again."""
    found = deduplicate_substrings(docs)
    changed = F.when(F.col("removed_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
