"""Topic labels made outside: the text sent out and the reply taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import preview
from postloom.operators.ranking import newest_first_order, positions
from postloom.schemas import LABEL_REPLY

# The row for posts in no list.
CATCH_ALL = "Other"
CATCH_ALL_KEYWORD = "unassigned"


def prompt_lines(posts: DataFrame) -> DataFrame:
    """Compact line per post: `[id] author: preview`."""
    line = F.concat(F.lit("["), "id", F.lit("] "), "author", F.lit(": "), preview(F.col("content"), 150, trim=True))
    return posts.select("id", "saved_at", line.alias("line"))


def prompt_batches(posts: DataFrame, size: int = 200) -> DataFrame:
    """Text block per batch of `size` posts, newest first, lines joined with line ends."""
    numbers = positions(posts, ["id"], newest_first_order())
    batch = (F.floor((F.col("position") - 1) / size) + 1).cast("bigint")
    rows = prompt_lines(posts).join(numbers, "id").select(
        batch.alias("batch"), F.struct("position", "line").alias("item"))
    items = F.array_sort(F.collect_list("item"))
    return rows.groupBy("batch").agg(F.array_join(F.transform(items, lambda i: i["line"]), "\n").alias("text"),
                                     F.count(F.lit(1)).alias("n"))


def _lists(text: str, mode: str) -> Column:
    """The lists of a reply; one inside a code fence is unwrapped."""
    raw = F.col(text)
    inside = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    body = F.when(F.contains(raw, F.lit("```")), inside).otherwise(raw)
    return F.from_json(body, LABEL_REPLY, {"mode": mode})


def malformed_replies(replies: DataFrame, text: str = "reply", key: str = "reply_id") -> DataFrame:
    """`(reply_id, reply)` of the replies that `parse_labels` cannot read: no valid JSON, or null."""
    return replies.where(_lists(text, "PERMISSIVE").isNull()).select(key, text)


def parse_labels(replies: DataFrame, text: str = "reply", key: str = "reply_id", strict: bool = True) -> DataFrame:
    """Lists of a JSON reply, one row per list with its position; a reply inside a code fence is unwrapped.

    A reply that is not valid JSON fails the job, or unless `strict` is left to `malformed_replies`.
    """
    lists = _lists(text, "FAILFAST" if strict else "PERMISSIVE")
    return replies.select(key, F.posexplode(lists).alias("pos", "label")).select(
        key, "pos", "label.name", "label.description",
        F.coalesce("label.keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("label.post_ids", F.array().cast("array<string>")).alias("post_ids"))


def number_labels(labels: DataFrame, key: str = "reply_id") -> DataFrame:
    """Lists with their cluster id: 1-based place over all replies in order (one reply: place in its array)."""
    # One row per reply: how many lists the replies before it have.
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    shift = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(
        key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = (F.col("pos") + F.col("_shift") + 1).cast("int")
    return labels.join(shift, key).withColumn("cluster_id", place).drop("_shift")


def _claims(numbered: DataFrame) -> DataFrame:
    """Cluster per claimed post id; a post in several lists goes to the last one."""
    return numbered.select("cluster_id", F.explode("post_ids").alias("id")).groupBy("id").agg(
        F.max("cluster_id").alias("cluster_id"))


def labels_to_assignments(posts: DataFrame, numbered: DataFrame) -> DataFrame:
    """`(id, cluster_id)` of every post; posts in no list get the id after the last list."""
    n = numbered.count()
    return posts.select("id").join(_claims(numbered), "id", "left").select(
        "id", F.coalesce(F.col("cluster_id"), F.lit(n + 1)).cast("int").alias("cluster_id"))


def labels_to_clusters(posts: DataFrame, numbered: DataFrame) -> DataFrame:
    """Cluster rows of the lists (size = ids claimed), and a catch-all row if a post is in no list."""
    n = numbered.count()
    listed = numbered.select(F.col("cluster_id").alias("id"), "keywords", F.col("name").alias("summary"),
                             F.size("post_ids").cast("bigint").alias("post_count"))
    rest = posts.select("id").join(_claims(numbered), "id", "left_anti").agg(
        F.count(F.lit(1)).alias("post_count")).where("post_count > 0")
    other = rest.select(F.lit(n + 1).alias("id"), F.array(F.lit(CATCH_ALL_KEYWORD)).alias("keywords"),
                        F.lit(CATCH_ALL).alias("summary"), "post_count")
    return listed.unionByName(other)
