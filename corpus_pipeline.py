"""The corpus pipeline: each stage is a `(spark, docs, sf_dir)` function, its result written and read again.

All stages but the last return the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import column, stored
from postloom.llm.components import components
from postloom.llm.exact import exact_groups
from postloom.llm.jaccard import jaccard_links
from postloom.llm.mixing import mixed_texts
from postloom.llm.packing import pack_documents
from postloom.llm.simhash import simhash_groups
from postloom.llm.toxicity import CATEGORIES, fit_chain, score_chain
from postloom.session import broadcast_if_small


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier chain does not flag as toxic; it is fitted on the labels and `docs`."""
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    scored = score_chain(docs, chain, docs.columns)
    return scored.where(~F.col("flags")[chain.categories.index("toxic")]).select(*map(column, docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text: the one with the largest id; of rows that repeat id and text, one.

    Copies are fewer than documents, so the rows that go are looked up, broadcast if that is proven small.
    """
    text = F.coalesce("text", F.lit(""))
    found = stored(exact_groups(docs), "copies", 1 + docs.count() // 1_000_000)
    goes = found.where(~F.col("kept")).select(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    twice = found.where("kept").groupBy(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha")).count().where(
        "count > 1").drop("count")
    named = docs.withColumn("_key", F.sha2(text.cast("binary"), 256))

    def among(rows: DataFrame, how: str) -> DataFrame:
        rows = broadcast_if_small(rows)
        return named.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_sha")), how)

    once = among(goes.union(twice), "left_anti")
    if not twice.isEmpty():
        once = once.union(among(twice, "left_semi").dropDuplicates(["doc_id", "_key"]))
    return once.select(*map(column, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more over five-word shingles, or near fingerprints. Rows are
    told apart by a number in the order of id and text, nulls last, so one of several rows with an id can go.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)]
    rows = stored(docs.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    prints = simhash_groups(rows, "_row").where("id <> component_id").select("id", "component_id")
    files = 1 + docs.count() // 1_000_000
    links = stored(prints.toDF("a", "b").union(jaccard_links(rows, "_row")), "near-links", files)
    goes = components(links, links.count()).where("id <> component_id").select(F.col("id").alias("_row"))
    return rows.join(broadcast_if_small(goes), "_row", "left_anti").select(*map(column, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts of the mix of sources; a document taken twice is there twice, one taken in part in part."""
    return mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the mixed documents lies in the packed sequences; a row of the mix is a document."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies),
          ("source_mix", mix), ("packing", pack)]

ORACLE_SQL = None  # tokenisation, fingerprints and the classifier have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
