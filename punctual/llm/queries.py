"""Registered queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm.bpe import round_trip
from punctual.llm.codes import ball_codes
from punctual.llm.counts import build_trees, edit_trees, redactions
from punctual.llm.entropy import learn_entropy, score_texts
from punctual.llm.jaccard import jaccard_components
from punctual.llm.languages import identify_languages, learn_languages
from punctual.llm.manifest import merkle_manifest, without_newlines
from punctual.llm.oracles import codes_sql, manifest_sql, warc_sql
from punctual.llm.packing import pack_texts
from punctual.llm.quality import grade_texts, labelled_sample, learn_grades
from punctual.llm.rules import repetition
from punctual.llm.substrings import deduplicate_substrings
from punctual.llm.vectors import near_duplicate_vectors
from punctual.llm.warc import read_warc, write_warc
from punctual.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int):
    """crc32 of doc_id as text, modulo `by`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


@query("op2_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = build_trees(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    edited = edit_trees(counted, path, redactions, keep=["doc_id", "n_tokens"])
    return edited.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded")


@query("op5_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


@query("op6_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"))
    model = learn_entropy(docs.where("not held_out"))
    return score_texts(docs.withColumn("train", ~F.col("held_out")), model, keep=["doc_id", "held_out"])


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_grades(labelled_sample(docs, table(spark, sf_dir, "labels")), 3)
    return grade_texts(docs, model, keep=["doc_id"])


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder(5) == 0, F.lit(False)))
    model = learn_languages(docs.where("not held_out"))
    found = identify_languages(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")


@query("op9_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op10_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_vector_codes", codes_sql())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes(table(spark, sf_dir, "embeddings"))


@query("op12_warc", warc_sql())
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_merkle_manifest", manifest_sql())
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), without_newlines())
