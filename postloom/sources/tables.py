"""Readers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.schemas import PAGES


def newest_first(posts: DataFrame) -> DataFrame:
    """Global order of a post listing; the id settles equal times."""
    return posts.orderBy(F.desc("saved_at"), "id")


def load_posts(store: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """Posts newest first, all or of one cluster (the filter reaches the Parquet scan)."""
    rows = store if cluster_id is None else store.where(F.col("cluster_id") == cluster_id)
    return newest_first(rows)


def load_clusters(store: DataFrame) -> DataFrame:
    return store.orderBy("id")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw pages from a Parquet table, or from saved HTML files (`fmt="html"`, one page per file)."""
    if fmt == "html":
        files = spark.read.text(path, wholetext=True)
        url = F.col("_metadata.file_path")
        return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))
    return spark.read.schema(PAGES).parquet(path)


def read_vectors(df: DataFrame, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Precomputed embeddings as ML vectors keyed by id; other columns stay."""
    return df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
                     *[c for c in df.columns if c not in (id_col, vec)])
