"""Session settings and the few helpers that must talk to the session itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame is broadcast only when a count proves that it stays under these bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "postloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; on a cluster leave `master` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in `spark.checkpoint.dir`. Only a local session may fall back to a scratch
    folder; on a cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="postloom-checkpoint-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read on from there (survives lost executors)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, prefix: str) -> str:
    """A fresh path for a working table inside the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when a count proves that `df` fits the broadcast limits.

    Map tasks count and one row each is added up; no row is moved.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= max_rows and seen["bytes"] <= max_bytes


def spread(df: DataFrame, max_bytes: int = 512 * 1024 * 1024) -> DataFrame:
    """Share a small input among all cores before work that is heavy per row.

    A small file is one split, so one core would do all the work. Above `max_bytes` (by Spark's own size
    estimate) the file splits suffice and nothing is shuffled.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= max_bytes else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                       max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its size is proven small, else unchanged (shuffled join, AQE skew split)."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
