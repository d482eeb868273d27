"""SimHash fingerprints and their near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree on some of the parts a fingerprint is cut into, so only those that
share such parts are compared. Within a group bit planes are stored vertically: word w of plane b holds bit
b of 64 fingerprints. One pass over the planes updates the distances of all fingerprints to the ones a
fixed number of places further on, with carry-save counters that remember only "more than the radius", and
is abandoned once all distances are beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import files_for, id_and_text, partitions, stored, text_slices, tidied
from postloom.llm.components import components

#: Fingerprints of a group that are compared in one piece; larger groups are cut into pairs of chunks.
CHUNK = 2048

RADIUS, PARTS, KEPT = 3, 5, 2  # at most three of five parts differ, so two agree


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`(id, fp)`: the SimHash of the word shingles of each text, as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [simhash(text.encode(), shingle) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.array(found, np.uint64).view(np.int64))],
                                             ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidied(run), "id long, fp long")


def simhash(text: bytes, shingle: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 (seed 42); no words give zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[shingle - 1:].tolist() or [len(joined)]
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _block_key(table: tuple[int, ...], parts: int) -> Column:
    """The bits of the given parts of a fingerprint, as a number."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    mask = sum(((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p] for p in table)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def near_links(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links `(a, b)` between distinct fingerprints (`rep, fp`) that connect all within the radius.

    Every pair within the radius is compared; what comes out is a spanning forest of each compared group, so
    a dense group gives as many rows as it has members, not as many as it has pairs.
    """
    tables = list(combinations(range(PARTS), KEPT))
    blocks = classes.select("rep", "fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), _block_key(parts, PARTS).alias("key")) for t, parts in enumerate(tables)])
    ).alias("b")).select("rep", "fp", "b.t", "b.key")
    sizes = blocks.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > chunk).select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    units = (blocks.join(large, ["t", "key"], "left")
             .select("t", "key", "rep", "fp", F.explode(F.when(F.col("chunks").isNull(), F.array(F.struct(
                 F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)).alias("u"))
             .select(F.xxhash64("t", "key", "u.i", "u.j").alias("unit"), "rep", "fp"))
    # Two units that share a number by chance are compared together, which only adds comparisons.
    ordered = units.repartition(partitions(classes.sparkSession), "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rep, fp in _whole_groups(batches):
            a, b = forest(unit, rep, fp)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 50_000
                  ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows in runs that end with a group."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def taken() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        n += batch.num_rows
        if n >= rows:
            unit, rep, fp = taken()
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut:
                yield unit[:cut], rep[:cut], fp[:cut]
            held, n = [(unit[cut:], rep[cut:], fp[cut:])], len(unit) - cut
    if n:
        yield taken()


def forest(unit: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the members of each unit that are within the radius of one another."""
    _, inverse, counts = np.unique(unit, return_inverse=True, return_counts=True)
    size = counts[inverse]
    order = np.lexsort((rep, inverse, -size))
    order = order[: int((size > 1).sum())]  # large units first, single members not at all
    rep, fp, group, size = rep[order], fp[order].view(np.uint64), inverse[order], size[order]
    n = len(rep)
    if not n:
        return rep, rep
    root = np.arange(n)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    words = -(-n // 64) + 1
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    for shift in range(1, int(size[0])):
        reach = int((size > shift).sum())  # members of units with a partner that far on
        i = within_radius(planes, shift, reach)
        i = i[(i + shift < n)]
        i = i[group[i] == group[np.minimum(i + shift, n - 1)]]
        i = i[root[i] != root[i + shift]]
        for x in i.tolist():
            a, b = x, x + shift
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(i):
            while not np.array_equal(up := root[root], root):
                root = up
    moved = np.flatnonzero(root != np.arange(n))
    return rep[moved], rep[root[moved]]


def within_radius(planes: np.ndarray, shift: int, reach: int, step: int = 16) -> np.ndarray:
    """Places up to `reach` whose fingerprint differs from the one `shift` places on in at most three bits."""
    word, bit = divmod(shift, 64)
    wide = min(-(-reach // 64), planes.shape[1] - word)
    low = high = over = np.zeros(wide, np.uint64)
    for at in range(0, 64, step):
        here = planes[at:at + step]
        there = here[:, word:word + wide] >> np.uint64(bit)
        if bit:
            more = here[:, word + 1:word + 1 + wide]
            there[:, :more.shape[1]] |= more << np.uint64(64 - bit)
        zero = here[:, :wide] ^ there
        one = beyond = np.zeros_like(zero)
        while len(zero) > 1:  # counters of two bits, added pair by pair
            carry = zero[::2] & zero[1::2]
            zero = zero[::2] ^ zero[1::2]
            both = one[::2] ^ one[1::2]
            beyond = beyond[::2] | beyond[1::2] | one[::2] & one[1::2] | both & carry
            one = both ^ carry
        carry = low & zero[0]
        low = low ^ zero[0]
        both = high ^ one[0]
        over = over | beyond[0] | high & one[0] | both & carry
        high = both ^ carry
        if over.all() and (~over == 0).all():
            return np.empty(0, np.int64)
    return np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")[:reach])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`id, fingerprint, component_id` of every row: documents linked by fingerprints at most three bits apart.

    `component_id` is the smallest id reachable. Texts without words have the fingerprint zero and are linked
    like any other. Documents with one fingerprint are one member of the comparison, so copies cost nothing.
    Null ids take no part in the links; their rows get the component of their fingerprint, or null if no
    row with an id has it. Repeated rows keep their rows. An empty table gives no rows.
    """
    files = files_for(docs, 0.02)
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints", files)
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-classes", files)
    linked = components(near_links(classes.where("rep is not null")), classes.count())
    named = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select(
        "fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(named, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")
