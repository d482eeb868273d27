"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

ENGAGEMENT = T.StructType([T.StructField("likes", T.LongType()), T.StructField("comments", T.LongType())])
LINKS = T.ArrayType(T.StringType())

POSTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_profile", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("post_type", T.StringType()),
    T.StructField("saved_at", T.TimestampType()),
    T.StructField("engagement", ENGAGEMENT),
    T.StructField("links", LINKS),
    T.StructField("cluster_id", T.IntegerType()),
])

CLUSTERS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("post_count", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

ASSIGNMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("cluster_id", T.IntegerType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# Reply of an external labeller.
LABEL_REPLY = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("post_ids", T.ArrayType(T.StringType())),
]))
