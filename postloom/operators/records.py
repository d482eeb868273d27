"""Normalise and serialise post and cluster records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.schemas import ENGAGEMENT, LINKS


def _json_or_same(df: DataFrame, name: str, schema: T.DataType) -> Column:
    """Parse a JSON text column; leave one that is already parsed as it is."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.from_json(F.col(name), schema, {"mode": "FAILFAST"})
    return F.col(name).cast(schema)


def _timestamp_or_same(df: DataFrame, name: str) -> Column:
    return F.to_timestamp(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name)


def _or_default(df: DataFrame, name: str, default: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def normalize_posts(df: DataFrame) -> DataFrame:
    """Raw post records (text or parsed fields, optional ones possibly missing) to the `posts` schema."""
    cluster_id = F.col("cluster_id").cast("int") if "cluster_id" in df.columns else F.lit(None).cast("int")
    return df.select(
        "id", "url", "author", _or_default(df, "author_profile", "").alias("author_profile"), "content",
        _or_default(df, "post_type", "text").alias("post_type"),
        _timestamp_or_same(df, "saved_at").alias("saved_at"),
        _json_or_same(df, "engagement", ENGAGEMENT).alias("engagement"),
        _json_or_same(df, "links", LINKS).alias("links"),
        cluster_id.alias("cluster_id"),
    )


def normalize_clusters(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("int").alias("id"), _json_or_same(df, "keywords", LINKS).alias("keywords"), "summary",
        F.col("post_count").cast("bigint").alias("post_count"), _timestamp_or_same(df, "created_at").alias("created_at"),
    )


def _iso(name: str) -> Column:
    """ISO-8601 text with offset (session time zone UTC); a fraction only where there is one."""
    time = F.col(name).cast("timestamp")
    whole = time == F.date_trunc("second", time)
    return F.when(
        whole, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def to_storage(posts: DataFrame) -> DataFrame:
    """Posts with nested fields as JSON text and the time as ISO text."""
    return posts.withColumns({
        "saved_at": _iso("saved_at"), "engagement": F.to_json("engagement"), "links": F.to_json("links"),
    })


def clusters_to_storage(clusters: DataFrame) -> DataFrame:
    return clusters.withColumns({"keywords": F.to_json("keywords"), "created_at": _iso("created_at")})
