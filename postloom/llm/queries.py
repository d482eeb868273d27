"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import oracles
from postloom.llm.divergence import source_divergence
from postloom.llm.exact import exact_groups
from postloom.llm.lines import dedup_lines
from postloom.llm.merkle import verified_manifest
from postloom.llm.mixing import mix_documents
from postloom.llm.packing import pack_documents
from postloom.llm.pivots import near_vectors
from postloom.llm.quality import quality_verdicts
from postloom.llm.simhash import simhash_groups
from postloom.llm.substrings import dedup_substrings
from postloom.llm.tokenfiles import token_offsets, write_token_files
from postloom.llm.toxicity import toxicity
from postloom.llm.wordpieces import piece_counts
from postloom.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_links",
                        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    return token_offsets(spark, path)


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(documents(spark, sf_dir), labels).withColumnRenamed("id", "doc_id")


@query("op6_exact_dedup", """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op8_piece_counts")
def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op9_pivot_index")
def op9_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_vectors(vectors).withColumnRenamed("id", "vec_id")


@query("op11_merkle_manifest", oracles.MERKLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the checksum of the id, the text that is shown has lost its line ends."""
    docs = documents(spark, sf_dir)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verified_manifest(docs, {"text": shown}).withColumnRenamed("id", "doc_id")


@query("op12_source_divergence", oracles.DIVERGENCE)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


@query("op13_quality_rules", oracles.QUALITY)
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_verdicts(documents(spark, sf_dir), labels)
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
