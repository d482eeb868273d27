"""Best-fit packing of tokenised documents into sequences of bounded length.

Best fit as supersteps over ordered lengths. Documents are ordered by length, longest first, and numbered
within their length; open sequences are ordered by gap. A superstep takes all unplaced documents of one
length at once: their successor is the smallest gap that holds them, the n-th of them gets the n-th
sequence with that gap (conflicts go by rank), what is left over goes on to the next larger gap or opens
new sequences, and the gaps are updated. Since lengths are whole numbers up to the sequence length, a
superstep moves ranges of ranks, not rows: the driver only ever sees one count per length, and every row
finds its range by its own length and rank inside the tasks. Rows are ranked without a sort by their task
and their place among its rows of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import files_for, id_and_text, stored
from postloom.llm.tokens import encoded, load_definition

PIECES = ("id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps for `counts` documents per length: `(length, first rank, documents, first sequence, offset)`.

    Documents `first rank ...` of the length go to as many sequences from `first sequence` on, one each.
    """
    gaps: list[int] = []                                  # ascending, those with an open sequence
    open_runs: dict[int, list[tuple[int, int]]] = {}      # gap: runs of sequence numbers
    moves: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1] > run[0]:
            if gap not in open_runs:
                bisect.insort(gaps, gap)
                open_runs[gap] = []
            open_runs[gap].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                # New sequences, each filled with as many documents of this length as it holds.
                each = capacity // length
                full = max(1, left // each)
                deep = each if left >= each else left
                for level in range(deep):
                    moves.append((length, rank, full, sequences, level * length))
                    rank, left = rank + full, left - full
                put(capacity - deep * length, (sequences, sequences + full))
                sequences += full
                continue
            gap = gaps[at]
            low, high = open_runs[gap].pop()
            if not open_runs[gap]:
                del open_runs[gap]
                gaps.pop(at)
            taken = min(left, high - low)
            moves.append((length, rank, taken, low, capacity - gap))
            rank, left = rank + taken, left - taken
            put(gap, (low + taken, high))
            put(gap - length, (low, low + taken))
    return moves


def cut_pieces(docs: DataFrame, capacity: int, definition: str, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of the encoded documents with their task and their place among its pieces of that length."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids, bounds in encoded(batches, definition, end_id):
            sizes = np.diff(bounds)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            head = np.where(sizes % capacity == 0, capacity, sizes % capacity)[row]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            raw, base = memoryview(ids.astype("<u4")).cast("B"), (bounds[:-1][row] + start) * 4
            crc = [zlib.crc32(raw[a:a + b]) for a, b in zip(base.tolist(), (length * 4).tolist(), strict=True)]
            # Place among the pieces of one length: a stable sort brings them together.
            order = np.argsort(length, kind="stable")
            fresh = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - (np.cumsum(fresh) - fresh)[length[order]] + seen[length[order]]
            seen += fresh
            columns = {"id": rows.column("id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                       "part": pa.array(np.full(len(row), part), pa.int32()), "nth": pa.array(nth)}
            if with_ids:
                cuts = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                columns["ids"] = pa.ListArray.from_arrays(cuts, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                   tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack whole documents (ids plus the end id) into few sequences of at most `capacity` ids.

    One row per piece: `id, piece, start, length, ids_crc32, sequence_id, offset` (and `ids` on request).
    Only documents longer than `capacity` are cut, from their end, so that only the first piece can be
    shorter. A null or empty text is its end id alone; repeated rows and rows with a null id are packed like
    any others; an empty table gives no rows. Only the two named columns are read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = stored(cut_pieces(id_and_text(docs, id_col, text_col), capacity, load_definition(tokenizer), end_id,
                               with_ids), "pieces", files_for(docs, 2 if with_ids else 0.05))
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    moves = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 5)  # by length, then by rank
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(shift, ["part", "length"]).select(*names, (F.col("nth") + F.col("shift")).alias("rank"))
    # Moves in the order of the first rank over all lengths together, longest first.
    total = np.cumsum(moves[:, 2]) - moves[:, 2]
    base = {int(length): int(at) for length, at in zip(moves[::-1, 0], total[::-1], strict=True)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = np.zeros(capacity + 1, np.int64)
        bases[list(base)] = list(base.values())
        for batch in batches:
            rank = batch.column("rank").to_numpy() + bases[batch.column("length").to_numpy()]
            move = np.searchsorted(total, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(moves[move, 3] + rank - total[move]),
                 pa.array(moves[move, 4])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, "
                             + "ids array<int>, " * with_ids + "sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: `sequence_id, ids, doc_ids, lengths` in order."""
    # A sequence holds at most `capacity` ids, so a group is bounded.
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.id").alias("doc_ids"),
        F.col("p.length").alias("lengths"))
