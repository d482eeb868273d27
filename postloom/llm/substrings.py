"""Removal of repeated word sequences between documents, with a count-min prefilter.

First pass: every task counts, in a sketch of its own, in how many documents the windows of its texts occur;
the sketches are merged shard by shard. A sketch only ever overestimates, so a window it has seen in one
document is in one document, and no repeated window is lost. Second pass: only windows estimated in two
documents or more are grouped, by 96 bits of their hashes, each with the smallest id it occurs in.

To keep the sketch small it does not count windows themselves but, for each window, the five-word sequence in
it with the smallest hash. Equal windows have the same one, so its count is at least theirs, and neighbouring
windows share it, so there is about one for five words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import column, partitions, text_slices

WINDOW, GRAM = 13, 5

#: The sketch has a bit for every four bytes of text, within these bounds. A sketch that is too small for a
#: corpus lets more windows through to the exact pass; it loses none.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29

SHARD_BITS = 16

#: Cells a task gathers before it hands them on.
CELLS = 8_000_000

#: Text worked on at once; within it a window goes on once, whatever the number of documents that have it.
SLICE_BYTES = 6 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _Words:
    """The words of a slice of texts as 128-bit hashes, and hashes of runs of words."""

    def __init__(self, texts: pa.Array):
        from xxhash import xxh3_128_digest

        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        if b"" in words:
            full = codes != words.index(b"")
            codes, row = codes[full], row[full]
        hashes = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        self.n, self.row = len(codes), row
        self.first = np.searchsorted(row, np.arange(len(texts) + 1))
        powers = np.full(self.n, BASE, np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(half[codes] * powers, dtype=np.uint64)])
                     for half in (hashes[:, 0], hashes[:, 1])]

    def runs(self, length: int, half: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of `length` words from each place on (or from the places `at`)."""
        sums = self.sums[half]
        if at is None:
            at = np.arange(max(0, self.n - length + 1))
        back = np.full(self.n + 1, INVERSE, np.uint64)
        back[:1] = 1
        back = np.cumprod(back, dtype=np.uint64)
        return _mixed((sums[at + length] - sums[at]) * back[at])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window starts, and the key under which the sketch counts it."""
        at = np.arange(max(0, self.n - WINDOW + 1))
        inside = self.row[at] == self.row[at + WINDOW - 1] if len(at) else np.zeros(0, bool)
        least = self.runs(GRAM, 0)
        width, wanted = 1, WINDOW - GRAM + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            width += step
        return at[inside], least[:len(at)][inside]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each key in the two rows of the sketch."""
    half = bits // 2
    second = keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - (half.bit_length() - 1))
    return keys & np.uint64(half - 1), second + np.uint64(half)


def build_sketch(texts: DataFrame, bits: int) -> np.ndarray:
    """Packed bits: cells that windows of two documents or more fall into.

    Each shard of the sketch is merged in one place, row by row; only the finished bits (at most `MOST_BITS`)
    come to the driver.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def handed_on() -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            shard, low = cells >> np.uint64(SHARD_BITS), (cells & np.uint64(65535)).astype("<u2")
            shards, starts = np.unique(shard, return_index=True)
            ends = [*starts[1:].tolist(), len(cells)]
            once, more = [], []
            for a, b in zip(starts.tolist(), ends, strict=True):
                many = counts[a:b] > 1
                once.append(low[a:b][~many].tobytes())
                more.append(low[a:b][many].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(once, pa.binary()),
                                               pa.array(more, pa.binary())], ["shard", "once", "more"])

        for part in text_slices(batches, most=SLICE_BYTES // 2):
            words = _Words(part.column("text"))
            at, keys = words.windows()
            row = words.row[at]
            new = np.ones(len(at), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
            keys, row = keys[new], row[new]
            order = np.argsort(keys, kind="stable")  # rows of a key stay in order
            keys, row = keys[order], row[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
            held += _cells(keys[new], bits)
            n += 2 * int(new.sum())
            if n >= CELLS:
                yield handed_on()
                held, n = [], 0
        if n:
            yield handed_on()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, counts = None, np.zeros(1 << SHARD_BITS, np.uint8)

        def merged() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array(
                [np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])

        for batch in batches:
            for number, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard:
                    if shard is not None:
                        yield merged()
                    shard, counts = number, np.zeros(1 << SHARD_BITS, np.uint8)
                at = np.frombuffer(once, "<u2")
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(more, "<u2")] = 2
        if shard is not None:
            yield merged()

    shards = (texts.select("text").mapInArrow(gather, "shard int, once binary, more binary")
              .repartition(partitions(texts.sparkSession), "shard").sortWithinPartitions("shard")
              .mapInArrow(merge, "shard int, bits binary"))
    sketch = np.zeros(bits // 8, np.uint8)
    width = (1 << SHARD_BITS) // 8
    for r in shards.toLocalIterator():
        sketch[r["shard"] * width:(r["shard"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return sketch


def candidate_windows(texts: DataFrame, sketch: np.ndarray, bits: int) -> DataFrame:
    """Windows the sketch lets through: `h1, h2, id, key, places, sure`.

    Within a slice of texts only the smallest id of a window goes on to the exact grouping, with all its
    places; the same window under a larger id is removed for sure, and comes as one row per document. A window
    that a third of all documents share is thus one row per slice.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sketch)  # at most MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value

        def repeated(cells: np.ndarray) -> np.ndarray:
            return seen[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1 > 0

        for part in text_slices(batches, most=SLICE_BYTES):
            words = _Words(part.column("text"))
            at, keys = words.windows()
            first, second = _cells(keys, bits)
            at = at[repeated(first)]
            second = second[repeated(first)]
            at = at[repeated(second)]
            ids, keyed = part.column("id").to_numpy(), part.column("key").to_numpy()
            row = words.row[at]
            h1, h2 = words.runs(WINDOW, 0, at), words.runs(WINDOW, 1, at)
            order = np.lexsort((at, keyed[row], ids[row], h2, h1))
            at, row, h1, h2 = at[order], row[order], h1[order], h2[order]
            place = (at - words.first[row]).astype("<i4")
            new = np.ones(len(at), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            window = np.cumsum(new) - 1
            lowest = ids[row][new][window] if len(at) else np.zeros(0, np.int64)
            sure = ids[row] > lowest
            # Open: one row per window and document (rows that repeat an id share it).
            h1, h2, place_open, row_open = h1[~sure], h2[~sure], place[~sure], row[~sure]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row_open[1:] != row_open[:-1])
            cuts = np.append(np.flatnonzero(new), len(h1))
            order = np.lexsort((place[sure], row[sure]))
            place_sure, row_sure = place[sure][order], row[sure][order]
            rows, starts = np.unique(row_sure, return_index=True)
            ends = np.append(starts, len(row_sure))
            opened = row_open[new]
            lists = pa.concat_arrays([_slices(place_open, cuts), _slices(place_sure, ends)])
            # In document order neighbours share their id and key, which the shuffle's compression likes.
            order = np.lexsort((np.concatenate([place_open[new], place_sure[ends[:-1]]]), np.concatenate([opened, rows])))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([h1[new].view(np.int64), ids[rows]])),
                pa.array(np.concatenate([(h2[new] >> np.uint64(32)).astype(np.uint32).view(np.int32), keyed[rows]])),
                pa.array(ids[np.concatenate([opened, rows])]), pa.array(keyed[np.concatenate([opened, rows])]), lists,
                pa.array(np.repeat([False, True], [len(opened), len(rows)]))],
                ["h1", "h2", "id", "key", "places", "sure"]).take(pa.array(order))

    return texts.mapInArrow(run, "h1 long, h2 int, id long, key int, places binary, sure boolean")


def _slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as binary values."""
    offsets = pa.py_buffer((cuts * 4).astype("<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                     bits: int | None = None) -> DataFrame:
    """`id, n_words, n_removed, kept_sha256` of every row (and `kept_text`, `removed` spans on request).

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id; windows
    are judged on the input. Kept words are joined by one space. A null or empty text has no words. Rows with
    a null id lose nothing and take nothing from others. Rows that repeat an id are one document to each
    other: neither loses words to the other. An empty table gives no rows.
    """
    texts = docs.select(column(id_col).cast("bigint").alias("id"),
                        F.coalesce(column(text_col), F.lit("")).alias("text")).withColumn("key", F.hash("text"))
    known = texts.where("id is not null")
    if bits is None:
        size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (size // 4).bit_length()))
    found = candidate_windows(known, build_sketch(known, bits), bits)
    # Rows that are sure have no window to be grouped by; their own hash spreads them.
    same = Window.partitionBy("h1", "h2", "sure")
    judged = found.withColumn("least", F.min("id").over(same)).where("sure or least < id")
    removed = judged.groupBy("id", "key").agg(F.collect_list("places").alias("places"))
    joined = texts.join(removed, ["id", "key"], "left").select("id", "text", "places")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "removed": []}
            for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                words = text.encode().split()
                spans = np.zeros((0, 2), np.int64)
                gone = 0
                if places:
                    at = np.unique(np.frombuffer(b"".join(places), "<i4").astype(np.int64))
                    opens = np.append(True, np.diff(at) > WINDOW)
                    spans = np.stack([at[opens], at[np.append(opens[1:], True)] + WINDOW], axis=1)
                    gone = int((spans[:, 1] - spans[:, 0]).sum())
                kept, last = [], 0
                for a, b in spans.tolist():
                    kept += words[last:a]
                    last = b
                text = b" ".join(kept + words[last:])
                out["n_words"].append(len(words))
                out["n_removed"].append(gone)
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out["kept_text"].append(text.decode())
                    out["removed"].append([{"start": a, "stop": b} for a, b in spans.tolist()])
            arrays = [part.column("id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                      pa.array(out["kept_sha256"], pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                arrays += [pa.array(out["kept_text"], pa.string()), pa.array(out["removed"], span)]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(keep, "id long, n_words long, n_removed long, kept_sha256 string" + (
        ", kept_text string, removed array<struct<start:bigint,stop:bigint>>" if with_text else ""))
