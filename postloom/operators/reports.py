"""Cluster summaries, details and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.records import comments_of, is_engaged, likes_of
from postloom.functions.text import head_items, preview
from postloom.operators.ranking import newest_first_order, positions
from postloom.session import broadcast_if_small


class NotEnoughPosts(ValueError):
    pass


class NoClusters(ValueError):
    pass


class UnknownCluster(ValueError):
    pass


def require_min(posts: DataFrame, n: int = 6) -> DataFrame:
    """Raise unless there are at least `n` posts; reads no more than `n` rows."""
    have = posts.limit(n).count()
    if have < n:
        raise NotEnoughPosts(f"need at least {n} posts, have {have}")
    return posts


def pick_clusters(clusters: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """All clusters or one; raise if there are none at all or the id is unknown."""
    if clusters.isEmpty():
        raise NoClusters("no clusters found")
    if cluster_id is None:
        return clusters
    one = clusters.where(F.col("id") == cluster_id)
    if one.isEmpty():
        raise UnknownCluster(f"cluster {cluster_id} not found")
    return one


def with_clusters(posts: DataFrame, clusters: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """Posts of known clusters with their cluster's columns (`c_…`).

    The cluster table is broadcast once its size is proven small, so a cluster that holds a third of all
    posts causes no skewed shuffle.
    """
    if cluster_id is not None:
        posts = posts.where(F.col("cluster_id") == cluster_id)
    named = clusters.select(*[F.col(c).alias(f"c_{c}") for c in clusters.columns])
    return posts.join(broadcast_if_small(named), F.col("cluster_id") == F.col("c_id"))


def post_count(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("n"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def engaged_posts(posts: DataFrame) -> DataFrame:
    return posts.where(is_engaged(F.col("engagement")))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Cluster table: id, title, size, keywords and the four keywords shown."""
    return clusters.select("id", "summary", "post_count", "keywords",
                           head_items(F.col("keywords"), 4, ", ").alias("shown_keywords"))


def engagement_line(engagement: Column, sep: str) -> Column:
    """`Likes: 1,234` and `Comments: 5` with thousands separators, joined by `sep`; null where both are zero."""
    return F.when(is_engaged(engagement), F.concat(
        F.lit("Likes: "), F.format_number(likes_of(engagement), 0), F.lit(sep),
        F.lit("Comments: "), F.format_number(comments_of(engagement), 0)))


def cluster_detail(posts: DataFrame, clusters: DataFrame, cluster_id: int) -> DataFrame:
    """Posts of a cluster, numbered newest first, with the cluster's header columns; no rows for an unknown id."""
    members = posts.where(F.col("cluster_id") == cluster_id)
    numbers = positions(members, ["id"], newest_first_order(), name="number")
    header = clusters.where(F.col("id") == cluster_id)
    return with_clusters(members, header).join(numbers, "id").select(
        F.col("c_id").alias("cluster_id"), F.col("c_summary").alias("summary"),
        F.col("c_post_count").alias("post_count"), F.array_join("c_keywords", ", ").alias("keywords"),
        "number", "id", "author", preview(F.col("content"), 120).alias("preview"), "url",
        head_items(F.col("links"), 3, ", ").alias("shown_links"),
        F.coalesce(engagement_line(F.col("engagement"), "  "), F.lit("")).alias("counts"))


def status(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: number of posts, number of clusters."""
    n_posts = posts.agg(F.count(F.lit(1)).alias("post_count"))
    n_clusters = clusters.agg(F.count(F.lit(1)).alias("cluster_count"))
    return n_posts.join(n_clusters, F.lit(True))  # two single-row aggregates
