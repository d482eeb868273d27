"""Exports of clusters with their posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.records import comments_of, likes_of
from postloom.functions.text import preview
from postloom.operators.ranking import newest_first_order, positions
from postloom.operators.reports import engagement_line, pick_clusters, with_clusters
from postloom.session import broadcast_if_small
from postloom.sources.store import write_csv, write_json, write_text

PART_ROWS = 500


def export_flat(posts: DataFrame, clusters: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """One row per clustered post: 11 columns, plus `saved_at` to order by. Empty clusters give no row."""
    engagement = F.col("engagement")
    return with_clusters(posts, pick_clusters(clusters, cluster_id), cluster_id).select(
        F.col("c_id").alias("cluster_id"), F.col("c_summary").alias("cluster_summary"),
        F.array_join("c_keywords", ", ").alias("cluster_keywords"), F.col("id").alias("post_id"), "author",
        "content", "post_type", likes_of(engagement).alias("engagement_likes"),
        comments_of(engagement).alias("engagement_comments"), "url", F.array_join("links", "|").alias("links"),
        "saved_at")


def write_flat(flat: DataFrame, path: str) -> None:
    """Flat export as CSV in listing order."""
    write_csv(flat.orderBy("cluster_id", F.desc("saved_at"), "post_id").drop("saved_at"), path)


def export_nested(posts: DataFrame, clusters: DataFrame, cluster_id: int | None = None,
                  part_rows: int = PART_ROWS) -> DataFrame:
    """Cluster objects with their posts as a nested array, newest first; empty clusters keep `[]`.

    A cluster of more than `part_rows` posts continues in further objects (`part` 1, 2, …), so that no
    array outgrows its task however large the cluster; all posts are kept.
    """
    chosen = pick_clusters(clusters, cluster_id)
    members = with_clusters(posts, chosen, cluster_id)
    numbers = positions(members, ["id"], newest_first_order(), group="cluster_id")
    parts = numbers.select("id", "position", (F.floor((F.col("position") - 1) / part_rows) + 1).cast("bigint")
                           .alias("part"))
    post = F.struct("id", "author", "content", "url", "post_type", "engagement", "links")
    slim = posts.join(parts, "id").select("cluster_id", "part", F.struct("position", post.alias("post")).alias("item"))
    nested = slim.groupBy("cluster_id", "part").agg(F.array_sort(F.collect_list("item")).alias("items"))
    nested = nested.select("cluster_id", "part", F.transform("items", lambda i: i["post"]).alias("posts"))
    empty = F.array().cast(nested.schema["posts"].dataType)
    head = broadcast_if_small(chosen.select("id", "summary", "keywords", "post_count"))
    filled = nested.join(head, F.col("cluster_id") == F.col("id"))
    used = numbers.select(F.col("cluster_id").alias("id")).distinct()
    bare = chosen.join(used, "id", "left_anti").select(
        "id", "summary", "keywords", "post_count", F.lit(1).cast("bigint").alias("part"), empty.alias("posts"))
    return filled.select("id", "summary", "keywords", "post_count", "part", "posts").unionByName(bare)


def write_nested(nested: DataFrame, path: str) -> None:
    write_json(nested.orderBy("id", "part"), path)


def export_markdown(posts: DataFrame, clusters: DataFrame, cluster_id: int | None = None,
                    title: str = "Saved Posts Export") -> DataFrame:
    """Markdown report as blocks: the title, a heading block per cluster (empty ones too), one block per post.

    Sorted by `cluster_id`, `block`, newest first, and joined with line ends, the blocks are the document.
    """
    chosen = pick_clusters(clusters, cluster_id)
    none = F.lit(None)
    top = chosen.sparkSession.range(1).select(
        F.lit(None).cast("int").alias("cluster_id"), F.lit(0).alias("block"), none.cast("timestamp").alias("saved_at"),
        F.lit("").alias("post_id"), F.lit(f"# {title}\n").alias("md"))
    heading = chosen.select(
        F.col("id").alias("cluster_id"), F.lit(0).alias("block"), none.cast("timestamp").alias("saved_at"),
        F.lit("").alias("post_id"),
        F.concat(F.lit("## "), "summary", F.lit(" ("), F.col("post_count").cast("string"), F.lit(" posts)\n"),
                 F.lit("**Keywords:** "), F.array_join("keywords", ", "), F.lit("\n")).alias("md"))
    foot = chosen.select(F.col("id").alias("cluster_id"), F.lit(2).alias("block"),
                         none.cast("timestamp").alias("saved_at"), F.lit("").alias("post_id"), F.lit("").alias("md"))
    external = F.transform(F.slice("links", 1, 3), lambda link: F.concat(F.lit("[link]("), link, F.lit(")")))
    body = with_clusters(posts, chosen, cluster_id).select(
        F.col("c_id").alias("cluster_id"), F.lit(1).alias("block"), F.col("saved_at").cast("timestamp"),
        F.col("id").alias("post_id"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("- **"), "author", F.lit("**: "), preview(F.col("content"), 200)),
            F.concat(F.lit("  - ["), "url", F.lit("]("), "url", F.lit(")")),
            F.when(F.size("links") > 0, F.concat(F.lit("  - External: "), F.array_join(external, ", "))),
            F.concat(F.lit("  - "), engagement_line(F.col("engagement"), " | ")),
        ).alias("md"))
    return top.unionByName(heading).unionByName(body).unionByName(foot)


def write_markdown(blocks: DataFrame, path: str) -> None:
    """The whole document in order (globally sorted part files)."""
    write_text(blocks.orderBy(F.asc_nulls_first("cluster_id"), "block", F.desc("saved_at"), "post_id"), path)
