"""Resumable ingest as a stream.

The store is a folder with one sub-folder per stream and micro-batch. A batch only ever adds posts whose
id is not stored yet, so it is appended and nothing stored is rewritten. A batch that is run again after a
failure overwrites its own sub-folder and ignores what it wrote before. A stream that starts anew (its
progress folder was lost) has another name, so it cannot overwrite earlier batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.operators.ingest import cap, first_seen, new_only
from postloom.session import checkpointed, is_small


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All stored posts with the stream and the number of the batch that brought them."""
    full = T.StructType([*schema.fields, T.StructField("stream", T.StringType()),
                         T.StructField("batch", T.LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def ingest_batch(posts: DataFrame, store: str, stream: str, number: int, order: str = "ord",
                 waiting: str | None = None) -> None:
    """Add the posts of a micro-batch that are not stored yet; may be repeated.

    With `waiting` they are added there, with their scan order, unless they are stored or wait already.
    """
    # Read several times below: written once, so the extraction runs once.
    posts = checkpointed(first_seen(posts, order))
    spark = posts.sparkSession
    schema = T.StructType([f for f in posts.schema.fields if f.name != order])
    target = store if waiting is None else waiting
    others = (F.col("stream") != stream) | (F.col("batch") != number)
    known = read_store(spark, target, schema if waiting is None else posts.schema).where(others).select("id")
    if waiting is not None:
        known = known.union(read_store(spark, store, schema).select("id"))
    fresh = new_only(posts, known, small=is_small(posts.select("id")))
    fresh = fresh.drop(order) if waiting is None else fresh
    fresh.write.mode("overwrite").parquet(f"{target}/stream={stream}/batch={number}")


def release(spark: SparkSession, waiting: str, store: str, schema: T.StructType, max_new: int | None,
            order: str = "ord") -> None:
    """Store the first `max_new` waiting posts, in the order of their batches and their scan order there.

    All of them for None or 0.
    """
    stored = read_store(spark, store, T.StructType([f for f in schema.fields if f.name != order]))
    left = new_only(read_store(spark, waiting, schema), stored)
    left = left.withColumn("_at", F.struct("batch", order))
    number = (stored.where("stream = 'released'").agg(F.max("batch")).first()[0] or 0) + 1
    cap(left, max_new, "_at").drop("stream", "batch", order, "_at").write.mode("overwrite").parquet(
        f"{store}/stream=released/batch={number}")


def stream_ingest(spark: SparkSession, source: DataFrame, store: str, checkpoint: str,
                  to_posts: Callable[[DataFrame], DataFrame], max_new: int | None = None,
                  order: str = "ord") -> None:
    """Run a file stream through dedup and skip-known into the store until its input is used up.

    `to_posts` turns a micro-batch of source rows into posts with the scan order column. With `max_new`, new
    posts first wait in a folder beside the store, and each run stores the first `max_new` of those that wait:
    a later run takes the rest, with or without new input, so none is lost, and the result does not depend on
    how the input is cut into batches of one run. A run without `max_new` first stores all that still wait, so
    that an earlier post comes before a later one of its id.
    """
    folder = f"{store.rstrip('/')}-waiting"
    waiting = folder if max_new else None
    schema = to_posts(spark.createDataFrame([], source.schema)).schema

    def ingest(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_batch(to_posts(batch), store, stream, number, order, waiting)

    if waiting is None and _exists(spark, folder):
        release(spark, folder, store, schema, None, order)
    query = (source.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if waiting is not None:
        release(spark, waiting, store, schema, max_new, order)
