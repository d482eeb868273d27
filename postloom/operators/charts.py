"""Chart-ready tables: hierarchy, 2-D projection, graph."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import head_items, preview
from postloom.operators.reports import with_clusters
from postloom.sources.tables import read_vectors

# Labels and the least number of projected points.
ROOT_LABEL = "All Posts"
GRAPH_ROOT = "Saved Posts"
MIN_PROJECTED = 4


def treemap_nodes(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of a three-level hierarchy: root, clusters, posts.

    `node_id` and `parent_id` are unique even where two clusters have the same title; labels are for show.
    """
    root = posts.sparkSession.range(1).select(
        F.lit("root").alias("node_id"), F.lit("").alias("parent_id"), F.lit(ROOT_LABEL).alias("label"),
        F.lit("").alias("parent"), F.lit(0).alias("value"), F.lit("").alias("text"), F.lit(0).alias("cluster_id"))
    label = F.concat(F.col("summary"), F.lit(" ("), F.col("post_count").cast("string"), F.lit(")"))
    level1 = clusters.select(
        F.concat(F.lit("cluster_"), F.col("id").cast("string")).alias("node_id"), F.lit("root").alias("parent_id"),
        label.alias("label"), F.lit(ROOT_LABEL).alias("parent"), F.lit(0).alias("value"),
        head_items(F.col("keywords"), 4, ", ").alias("text"), F.col("id").alias("cluster_id"))
    parent = F.concat(F.col("c_summary"), F.lit(" ("), F.col("c_post_count").cast("string"), F.lit(")"))
    links = F.when(F.size("links") > 0, F.concat(F.lit("<br>Links: "), head_items(F.col("links"), 2, ", ")))
    level2 = with_clusters(posts, clusters).select(
        F.concat(F.lit("post_"), "id").alias("node_id"),
        F.concat(F.lit("cluster_"), F.col("c_id").cast("string")).alias("parent_id"),
        F.concat("author", F.lit(": "), preview(F.col("content"), 80, trim=True), F.lit("...")).alias("label"),
        parent.alias("parent"), F.lit(1).alias("value"),
        F.concat("url", F.coalesce(links, F.lit(""))).alias("text"), F.col("c_id").alias("cluster_id"))
    return root.unionByName(level1).unionByName(level2)


def scatter_points(posts: DataFrame, clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """2-D projection (first two principal components) of the clustered posts, with hover text.

    Empty below four posts. A post without a vector has no place: its x and y are null.
    """
    hover = F.concat(F.lit("<b>"), "author", F.lit("</b><br>"), preview(F.col("content"), 120, trim=True),
                     F.lit("..."))
    points = with_clusters(posts, clusters).select(
        "id", hover.alias("text"), F.col("c_id").alias("cluster_id"), F.col("c_summary").alias("cluster_name"))
    joined = points.select("id").join(read_vectors(vectors), "id")  # the fit takes posts with a vector only
    if joined.limit(MIN_PROJECTED).count() < MIN_PROJECTED:
        return points.where(F.lit(False)).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "text",
                                                 "cluster_id", "cluster_name")
    model = PCA(k=2, inputCol="features", outputCol="projected").fit(joined.select("features"))
    xy = vector_to_array("projected")
    places = model.transform(joined).select("id", xy[0].alias("x"), xy[1].alias("y"))
    return points.join(places, "id", "left").select("id", "x", "y", "text", "cluster_id", "cluster_name")


def network_nodes(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nodes of the star of stars root, clusters, posts."""
    empty = F.lit("")
    root = posts.sparkSession.range(1).select(
        F.lit("root").alias("id"), F.lit(GRAPH_ROOT).alias("label"), F.lit(30).cast("bigint").alias("size"),
        F.lit("root").alias("type"), empty.alias("keywords"), empty.alias("preview"), empty.alias("url"))
    middle = clusters.select(
        F.concat(F.lit("cluster_"), F.col("id").cast("string")).alias("id"), F.col("summary").alias("label"),
        (F.col("post_count") + 20).alias("size"), F.lit("cluster").alias("type"),
        head_items(F.col("keywords"), 4, ", ").alias("keywords"), empty.alias("preview"), empty.alias("url"))
    leaves = with_clusters(posts, clusters).select(
        F.concat(F.lit("post_"), "id").alias("id"), F.col("author").alias("label"),
        F.lit(8).cast("bigint").alias("size"), F.lit("post").alias("type"), empty.alias("keywords"),
        preview(F.col("content"), 60, trim=True).alias("preview"), "url")
    return root.unionByName(middle).unionByName(leaves)


def network_edges(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges root to cluster and cluster to post."""
    inner = clusters.select(F.lit("root").alias("source"),
                            F.concat(F.lit("cluster_"), F.col("id").cast("string")).alias("target"))
    outer = with_clusters(posts, clusters).select(
        F.concat(F.lit("cluster_"), F.col("c_id").cast("string")).alias("source"),
        F.concat(F.lit("post_"), "id").alias("target"))
    return inner.unionByName(outer)
