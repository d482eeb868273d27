"""Exact dedup with a cuckoo-filter index over live digests.

The index has one row per digest (with the document that stays and the number of its copies), bucketed by
digest, and one cuckoo filter per bucket. A filter miss proves that a digest is new; a hit is verified
against the stored digests of its bucket. A live digest whose document is replaced is deleted and inserted
anew. A filter that overflows is built anew, twice as large, from the stored digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import column, files_for, stored

INDEX = "bucket int, digest binary, keep_id long, group_size long, filter binary"

#: Digests a bucket is planned for.
BUCKET_DIGESTS = 50_000

#: Rows of a map task whose copies are combined at once.
RUN_ROWS = 100_000


class CuckooFilter:
    """Set of digests (bytes with uniform bits) with deletion: two candidate rows of four 16-bit marks each."""

    SLOTS, KICKS = 4, 200

    def __init__(self, rows: int = 64):
        self.rows = rows  # a power of two
        self.marks = [0] * (rows * self.SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.rows - 1)
        return mark, first, self._other(first, mark)

    def _other(self, row: int, mark: int) -> int:
        return (row ^ (mark * 0x5BD1E995 >> 3)) & (self.rows - 1)

    def _find(self, row: int, mark: int) -> int:
        at = row * self.SLOTS
        for i in range(at, at + self.SLOTS):
            if self.marks[i] == mark:
                return i
        return -1

    def maybe(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return self._find(a, mark) >= 0 or self._find(b, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False if there is no room; the filter must then be built anew from its keys."""
        mark, a, b = self._places(digest)
        for row in (a, b):
            if (i := self._find(row, 0)) >= 0:
                self.marks[i] = mark
                return True
        row = a
        for kick in range(self.KICKS):
            i = row * self.SLOTS + (kick + mark) % self.SLOTS
            mark, self.marks[i] = self.marks[i], mark
            row = self._other(row, mark)
            if (i := self._find(row, 0)) >= 0:
                self.marks[i] = mark
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Only for digests that were inserted."""
        mark, a, b = self._places(digest)
        i = self._find(a, mark)
        self.marks[i if i >= 0 else self._find(b, mark)] = 0

    def to_bytes(self) -> bytes:
        return np.array(self.marks, "<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls(len(raw) // (2 * cls.SLOTS))
        made.marks = np.frombuffer(raw, "<u2").tolist()
        return made


class Bucket:
    """The live digests of a bucket behind their filter."""

    def __init__(self) -> None:
        self.filter = CuckooFilter()
        self.live: dict[bytes, tuple[int | None, int]] = {}

    def _add(self, digest: bytes, keep: int | None, size: int) -> None:
        self.live[digest] = (keep, size)
        if not self.filter.insert(digest):
            rows = self.filter.rows
            while True:  # overflow: built anew from the stored keys
                rows *= 2
                self.filter = CuckooFilter(rows)
                if all(map(self.filter.insert, self.live)):
                    return

    def insert(self, digest: bytes, keep: int | None, size: int) -> None:
        """Count `size` more documents with the digest; the largest id stays."""
        if not self.filter.maybe(digest) or digest not in self.live:
            self._add(digest, keep, size)
            return
        old, before = self.live[digest]
        if keep is None or old is not None and old >= keep:
            self.live[digest] = (old, before + size)
        else:
            self.delete(digest)
            self._add(digest, keep, before + size)

    def delete(self, digest: bytes) -> None:
        if self.filter.maybe(digest) and digest in self.live:
            self.filter.delete(digest)
            del self.live[digest]


def text_digests(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """`(id, digest)` of every row: the SHA-256 of the text, a null text counted as empty."""
    text = column(text) if isinstance(text, str) else text
    return docs.select(column(id_col).cast("bigint").alias("id"),
                       F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("digest"))


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`digest, keep_id, group_size`: the copies of a digest among each `RUN_ROWS` rows of a task as one row."""
    def run(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by("digest").aggregate(
            [("id", "max"), ("id", "count", pc.CountOptions(mode="all"))])
        return found.select(["digest", "id_max", "id_count"]).rename_columns(
            ["digest", "keep_id", "group_size"]).to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= RUN_ROWS:
            yield from run(held)
            held, n = [], 0
    if n:
        yield from run(held)


def update_index(digests: DataFrame, index: DataFrame | None = None, deleted: DataFrame | None = None,
                 buckets: int | None = None) -> DataFrame:
    """The index after deleting the digests of `deleted` and then inserting all rows of `digests`.

    `digests` is `(id, digest)`, `deleted` `(digest)`, `index` an earlier result with the same number of
    buckets. One row per live digest (`bucket, digest, keep_id, group_size`) and one per bucket with its
    filter and a null digest. Map tasks combine the copies of a digest before the one shuffle, so a digest that
    a third of all documents share reaches its bucket as one row per task and run of rows; there the rows of
    several tasks meet in the filter and are verified against the live digests. Null ids count as copies but stay
    only where no copy has an id; repeated rows count as often as they occur.
    """
    if index is not None:
        buckets = 1 + (index.agg(F.max("bucket")).first()[0] or 0)
    elif buckets is None:
        n = digests.agg(F.approx_count_distinct("digest")).first()[0]
        buckets = 1 << max(3, (n // BUCKET_DIGESTS).bit_length())

    # Bits of the digest that the filter does not use.
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    none = F.lit(None)
    copies = digests.select("id", "digest").mapInArrow(combined, "digest binary, keep_id long, group_size long")
    steps = [copies.select(bucket, "digest", "keep_id", "group_size", none.cast("binary").alias("filter"),
                           F.lit(2).alias("step"))]
    if index is not None:
        steps.append(index.withColumn("step", F.lit(0)))
    if deleted is not None:
        steps.append(deleted.select(bucket, "digest", none.cast("bigint").alias("keep_id"),
                                    none.cast("bigint").alias("group_size"), none.cast("binary").alias("filter"),
                                    F.lit(1).alias("step")).distinct())
    rows = steps[0]
    for more in steps[1:]:
        rows = rows.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()),
                            ("group_size", pa.int64()), ("filter", pa.binary())])
        number: int | None = None
        held = Bucket()

        def result() -> pa.RecordBatch:
            keys, values = list(held.live), list(held.live.values())
            return pa.RecordBatch.from_arrays([
                pa.array([number] * (len(keys) + 1), pa.int32()), pa.array([*keys, None], pa.binary()),
                pa.array([*(v[0] for v in values), None], pa.int64()),
                pa.array([*(v[1] for v in values), None], pa.int64()),
                pa.array([*[None] * len(keys), held.filter.to_bytes()], pa.binary())], schema=schema)

        for batch in batches:  # sorted by bucket and step
            for b, digest, keep, size, marks, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != number:
                    if number is not None:
                        yield result()
                    number, held = b, Bucket()
                if step == 0 and digest is None:
                    held.filter = CuckooFilter.from_bytes(marks)
                elif step == 0:
                    held.live[digest] = (keep, size)
                elif step == 1:
                    held.delete(digest)
                else:
                    held.insert(digest, keep, size)
        if number is not None:
            yield result()

    ordered = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "step", "digest")
    return ordered.mapInArrow(run, INDEX)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """`id, keep_id, group_size, kept, text_sha256` of every row of `docs`.

    Of equal texts the row with the largest id stays; rows that repeat that id all stay (they are one
    document), and a text whose ids are all null keeps them all. A null text equals an empty one. An empty
    table gives no rows. Texts are compared by their SHA-256.
    """
    files = files_for(docs, 0.03)
    digests = stored(text_digests(docs, id_col, text), "digests", files)
    index = stored(update_index(digests), "digest-index", files).where("digest is not null")
    # The digest of a hot text is one row on the right; the sort-merge join splits its rows on the left.
    found = digests.join(index.select("digest", "keep_id", "group_size"), "digest")
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))
