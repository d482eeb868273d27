"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import shared_path

#: A word is a run of anything but the six ASCII white-space characters, as `bytes.split()` sees it.
WORD = r"[^\x20\x09-\x0D]+"

#: Text worked on at once inside a task.
SLICE_BYTES = 8 << 20


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write `df` to a fresh table in the shared checkpoint folder and read on from there.

    Cuts the lineage: a lost executor costs only the tasks it ran, and the table is read as often as wanted.
    With `files`, small rows are dealt to that many files first, whatever the number of tasks that made them.
    """
    path = shared_path(df.sparkSession, name)
    (df if files is None else df.repartition(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_for(source: DataFrame, share: float) -> int:
    """Files of about 64 MB for a table that has `share` of the bytes of `source`, by Spark's own estimate; no
    more than shuffle partitions, since the estimate of a joined source can be far too high."""
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(1 + int(size * share) // (64 << 20), partitions(source.sparkSession))


def column(name: str) -> Column:
    """A top-level column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, text)` of every row, null texts as empty ones; no other column can clash with what is added later."""
    return docs.select(column(id_col).cast("bigint").alias("id"),
                       F.coalesce(column(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column_name: str = "text",
                most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about `most` bytes of text each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column_name)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def worker_memory() -> dict:
    """A dictionary that lives as long as the Python worker, for caches that later tasks profit from."""
    home = sys.modules.setdefault("_corpus_worker_memory", types.ModuleType("_corpus_worker_memory"))
    return home.__dict__.setdefault("kept", {})


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
           ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for `mapInArrow`, without the caches other operators left in the Python worker, and giving the memory
    it freed back to the system at its end: a worker outlives its tasks and lies beside the JVM of the executor."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        worker_memory().clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux keeps freed memory
        if trim:
            trim(0)

    return tidy
