"""Token ids as Parquet files: lists of ids, dictionary coded, in document order, with page indexes.

A file holds `doc_id, n_tokens, ids` for a range of documents in ascending order. The id lists are
dictionary coded (a vocabulary fits one dictionary page), the numbers beside them delta coded. Row groups
have a bounded size and pages a bounded number of rows, with column and offset indexes, so a reader that
wants few documents or only the numbers reads few pages and no ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import id_and_text, partitions
from postloom.llm.tokens import encoded, load_definition

SCHEMA = "doc_id long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = 2, row_group_bytes: int = 64 << 20,
                      page_rows: int = 1000) -> None:
    """Encode every text, append `end_id`, and write the ids in ascending order of the id column.

    Texts are range-partitioned by id before they are encoded (text is smaller than ids), so the files
    follow one another. A null or empty text is its end id alone; null ids come first; rows with equal ids
    stand side by side, ordered by text; an empty table gives files without rows. Only the two named columns
    are read.
    """
    definition = load_definition(tokenizer)
    rows = id_and_text(docs, id_col, text_col)
    ordered = (rows.repartitionByRange(partitions(docs.sparkSession), F.asc("id"))
               .sortWithinPartitions(F.asc("id"), F.asc("text")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds in encoded(batches, definition, end_id):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds)), lists],
                                             ["doc_id", "n_tokens", "ids"])

    (ordered.mapInArrow(encode, SCHEMA).write
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.row.count.limit", str(page_rows))
     .option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .option("compression", "zstd")
     .parquet(path))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None,
                     with_ids: bool = True) -> DataFrame:
    """`doc_id, n_tokens, ids`; with `doc_ids` only their pages, without ids only the small columns are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows if with_ids else rows.drop("ids")


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, from the files.

    `start` counts the ids of all documents before it: ids of earlier files plus those before it in its file.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            bounds = (ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()) * 4
            raw = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(), "<u4")).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("place"), batch.column("doc_id"), batch.column("n_tokens"),
                 pa.array(crc, pa.int64())], ["file", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path)
    numbered = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"),
                           "doc_id", "n_tokens", "ids")
    digests = numbered.mapInArrow(digest, "file string, place long, doc_id long, n_tokens long, ids_crc32 long")
    # One row per file; a file whose first id is null comes first, as files share no ids.
    files = numbered.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct("place", "doc_id")).alias("at"))
    before = Window.orderBy(F.asc("at.doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return digests.join(files, "file").select(
        "doc_id", (F.col("shift") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens",
        "ids_crc32")
