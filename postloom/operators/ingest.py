"""Incremental ingest: dedup, skip known ids, cap, enrich, upsert, assign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.links import merge_links, urls_in_text
from postloom.operators.ranking import positions
from postloom.session import checkpointed, is_small

UPDATABLE = ["content", "engagement", "links"]
# Up to this many rows a global top-n is cheaper than a distributed sort of the keys.
TOP_N_ROWS = 5_000


def first_seen(df: DataFrame, order: str = "ord", key: str = "id") -> DataFrame:
    """First row per id in scan order.

    `row_number() = 1` lets Spark keep one row per id in each map task before the shuffle, so a hot id
    does not reach one task whole.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def new_only(incoming: DataFrame, known: DataFrame, key: str = "id", small: bool = False) -> DataFrame:
    """Incoming rows whose id is not known yet.

    With `small` (the caller has proven that the batch fits a broadcast, see `is_small`) the known ids
    are first reduced to those that occur in it, which spares the shuffle of the whole known set.
    """
    ids = known.select(key)
    if small:
        ids = ids.join(F.broadcast(incoming.select(key)), key, "left_semi")
    return incoming.join(ids, key, "left_anti")


def known_among(incoming: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows that are skipped because their id is known."""
    return incoming.join(known.select(key), key, "left_semi")


def cap(df: DataFrame, n: int | None, order: str = "ord", key: str = "id") -> DataFrame:
    """First `n` rows in scan order; no cap for None or 0."""
    if not n:
        return df
    if n <= TOP_N_ROWS:
        return df.orderBy(order, key).limit(n)
    kept = positions(df, [key], [F.col(order), F.col(key)]).where(F.col("position") <= n).select(key)
    return df.join(kept, key, "left_semi")


def ingest_counts(incoming: DataFrame, known: DataFrame, max_new: int | None = None, order: str = "ord",
                  key: str = "id") -> DataFrame:
    """One row of counters for a scan: synced, new, updated, skipped, total afterwards.

    Scanned ids are counted once. A scan stops at the cap, so an id is skipped only if it was seen
    before the last new row that fitted.
    """
    seen = first_seen(incoming.select(key, order), order, key)
    flagged = seen.join(known.select(key, F.lit(1).alias("_known")), key, "left")
    is_new = F.col("_known").isNull()
    if max_new:
        fresh = cap(flagged.where(is_new).select(key, order), max_new, order, key)
        stop = fresh.agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_last"))  # a single row
        flagged = flagged.join(F.broadcast(stop), (F.col("_n") < max_new) | (F.col(order) <= F.col("_last")))
    counts = flagged.agg(F.count_if(is_new).alias("synced"), F.count_if(~is_new).alias("skipped"))
    total = known.agg(F.count(F.lit(1)).alias("known"))
    # Both sides are single-row aggregates.
    return counts.join(total, F.lit(True)).select(
        "synced", F.col("synced").alias("new"), F.lit(0).cast("bigint").alias("updated"), "skipped",
        (F.col("known") + F.col("synced")).alias("total"))


def fold_batch(batch: DataFrame, updatable: list[str] = UPDATABLE, order: str = "ord", key: str = "id") -> DataFrame:
    """One row per id: insert-only columns of its first row, updatable ones of its last, and the row count.

    Partial aggregation folds a hot id in every map task.
    """
    fixed = [c for c in batch.columns if c not in (key, order, *updatable)]
    folded = batch.groupBy(key).agg(
        F.min_by(F.struct(*fixed), order).alias("_first"), F.max_by(F.struct(*updatable), order).alias("_last"),
        F.count(F.lit(1)).alias("_rows"))
    return folded.select(key, "_first.*", "_last.*", "_rows")


def upsert_posts(store: DataFrame, batch: DataFrame, updatable: list[str] = UPDATABLE, order: str = "ord",
                 key: str = "id", now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Store after the batch, and one row of counts (`new`, `updated`).

    A known id takes over only the updatable columns; a new id inserts the whole row. `updated_at` is
    set to `now` where a row was updated. A small batch is broadcast, so the store is not shuffled;
    otherwise both sides are joined by id (ids are unique on both sides, so there is no skew).
    """
    folded = checkpointed(fold_batch(batch, updatable, order, key))  # read three times below
    columns = store.columns
    stamps = [c for c in ("created_at", "updated_at") if c in columns and c not in folded.columns]
    now = F.current_timestamp() if now is None else now
    incoming = folded.withColumns({c: now for c in stamps}) if stamps else folded
    small = is_small(incoming)
    left = store.alias("s")
    right = incoming.withColumn("_hit", F.lit(1)).alias("b")
    same = F.col(f"s.{key}") == F.col(f"b.{key}")

    def merged(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(f"s.{key}"), F.col(f"b.{key}")).alias(name)
        stored, given = F.col(f"s.{name}"), F.col(f"b.{name}")
        touched = F.col("b._hit").isNotNull()
        if name in updatable:
            return F.when(touched, given).otherwise(stored).alias(name)
        if name == "updated_at":
            return F.when(touched & F.col(f"s.{key}").isNotNull(), now).when(touched, given).otherwise(stored).alias(name)
        return F.when(F.col(f"s.{key}").isNotNull(), stored).otherwise(given).alias(name)

    if small:
        kept = left.join(F.broadcast(right), same, "left").select(*[merged(c) for c in columns])
        fresh = new_only(incoming, store, key, small=True)
        result = kept.unionByName(fresh.select(*columns))
    else:
        result = left.join(right, same, "full_outer").select(*[merged(c) for c in columns])
        fresh = new_only(incoming, store, key)
    new_ids = fresh.agg(F.count(F.lit(1)).alias("new"))
    rows = folded.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"))
    counts = new_ids.join(rows, F.lit(True)).select("new", (F.col("rows") - F.col("new")).alias("updated"))
    return result, counts


def upsert_clusters(store: DataFrame, batch: DataFrame, order: str = "ord", key: str = "id") -> DataFrame:
    """Whole-row replace by id; the last row of the batch wins."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    winners = batch.withColumn("_rank", F.row_number().over(last)).where("_rank = 1")
    return store.join(winners.select(key), key, "left_anti").unionByName(winners.select(*store.columns))


def apply_assignments(posts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Set `cluster_id` of the posts named in `assignments`; an explicit null overwrites, others keep theirs."""
    given = assignments.select("id", F.col("cluster_id").alias("_cluster"), F.lit(True).alias("_matched"))
    value = F.when(F.col("_matched"), F.col("_cluster")).otherwise(F.col("cluster_id"))
    joined = posts.join(given, "id", "left").withColumn("cluster_id", value)
    return joined.select(*posts.columns)


def clear_clusters(posts: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts without cluster ids, and an empty cluster table."""
    return posts.withColumn("cluster_id", F.lit(None).cast("int")), clusters.where(F.lit(False))


def enrich_merge(posts: DataFrame, detail: DataFrame, key: str = "id") -> DataFrame:
    """Merge detail-page text and links into posts that have an address.

    The longer text wins (a tie keeps the stored one). Links become the distinct union of stored links,
    detail links and addresses in the merged text. Posts without a detail row stay as they are.
    """
    extra = detail.select(key, F.coalesce("detail_content", F.lit("")).alias("_text"),
                          F.col("detail_links").alias("_links"), F.lit(True).alias("_found"))
    found = F.coalesce(F.col("_found"), F.lit(False)) & (F.col("url") != "")
    longer = found & (F.length("_text") > F.length("content"))
    joined = posts.join(extra, key, "left").withColumn("content", F.when(longer, F.col("_text"))
                                                        .otherwise(F.col("content")))
    links = F.when(found, merge_links(F.col("links"), F.col("_links"), urls_in_text(F.col("content"))))
    return joined.withColumn("links", links.otherwise(F.col("links"))).select(*posts.columns)
