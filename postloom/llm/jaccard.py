"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates, each is verified exactly.

A document is first held against the smallest id of its buckets, then against the smallest of each bucket that is
not in its group by then. What remains are buckets with members of several groups. They are cut into chunks, and
each two chunks are compared inside a task, which returns links only; chunks of one large group do not meet. So a
group of near copies costs its size times the number of those in its buckets that are not in it, and no pair of
different groups in a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import files_for, id_and_text, stored, text_slices, tidied
from postloom.llm.components import components
from postloom.session import broadcast_if_small

#: A pair of similarity 0.8 shares a band with probability 0.9993, one of 0.3 with 0.02.
BANDS, ROWS = 24, 6

#: Members of a bucket that are compared at once.
CHUNK = 512

BANDED = "id long, keys array<long>"


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles of a text; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        out = _mixed(out + hashes[at:at + len(out)])
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_FACTORS = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1, 1) | np.uint64(1)


def band_keys(hashes: np.ndarray, step: int = 2048) -> np.ndarray:
    """One number per band: equal in two sets if the least values of all its hash functions are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, (hashes[at:at + step] * _FACTORS[0] + _FACTORS[1]).min(1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + column)
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _banded(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        found = [shingle_hashes(text.encode(), shingle) for text in part.column("text").to_pylist()]
        keys = [band_keys(x) if len(x) else np.empty(0, np.int64) for x in found]
        cuts = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
        lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(keys), pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "keys"])


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs `(a, b)` with at least the similarity; the texts of `docs` are read for those in pairs only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            left, right = (part.column(c).to_pylist() for c in ("text", "other"))
            # A text stands in many pairs; no slice holds more of them than its bytes.
            sets = {text: shingle_hashes(text.encode(), shingle) for text in {*left, *right}}
            good = [jaccard(sets[x], sets[y]) >= least for x, y in zip(left, right, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    some = broadcast_if_small(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = docs.join(some, "id", "left_semi")
    first = pairs.join(texts.select(F.col("id").alias("a"), "text"), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    return both.select("a", "b", "text", "other").mapInArrow(tidied(run), "a long, b long")


def _chunk_units(members: DataFrame) -> DataFrame:
    """Members of buckets with several groups (`key, id, root`) dealt to units of two chunks: `key, u, v, side, id, root`.

    A group with `CHUNK` members in a bucket has chunks of its own, the others share theirs.
    """
    per_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    owner = F.when(F.col("c") >= CHUNK, F.col("root")).otherwise(F.lit(None))
    pools = per_root.withColumn("owner", owner).groupBy("key", "owner").agg(F.sum("c").alias("c")).select(
        "key", "owner", F.ceil(F.col("c") / CHUNK).cast("int").alias("parts"))
    # One entry per chunk of a bucket.
    chunks = pools.select("key", "owner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    listed = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("owner", "part"))).alias("chunks"))
    placed = members.join(per_root.select("key", "root", owner.alias("owner")), ["key", "root"])
    pools = pools.select(F.col("key").alias("k"), F.col("owner").alias("o"), "parts")
    placed = placed.join(pools, (placed["key"] == pools["k"]) & placed["owner"].eqNullSafe(pools["o"])).join(listed, "key")
    numbered = F.transform("chunks", lambda x, i: F.named_struct(F.lit("owner"), x.owner, F.lit("part"), x.part,
                                                                 F.lit("at"), i))
    mine = F.filter(numbered, lambda x: x.owner.eqNullSafe(F.col("owner"))
                    & (x.part == F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    at = F.get(mine, F.lit(0)).getField("at").alias("mine")
    met = placed.select("key", "id", "root", "owner", at, F.posexplode("chunks").alias("other", "chunk")).where(
        F.col("owner").isNull() | ~F.col("chunk.owner").eqNullSafe(F.col("owner")))
    return met.select("key", F.least("mine", "other").alias("u"), F.greatest("mine", "other").alias("v"),
                      (F.col("mine") > F.col("other")).alias("side"), "id", "root")


def _shared(left: list[np.ndarray], right: list[np.ndarray], block: int = 2048) -> np.ndarray:
    """Common members of every set of `left` and every set of `right`."""
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def marked(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        found = np.zeros((len(sets), len(some)), np.float32)
        for row, values in zip(found, sets, strict=True):
            row[np.searchsorted(some, np.intersect1d(values, some, assume_unique=True))] = 1
        return found

    for at in range(0, len(common), block):
        some = common[at:at + block]
        out += marked(left, some) @ marked(right, some).T
    return out


def _unit_links(docs: DataFrame, units: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links `(a, b)` between different groups of a unit; of two groups, one link."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [shingle_hashes(t.encode(), shingle).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    def compare(table: pa.Table) -> pa.Table:
        sides, ids, roots = (table.column(c).to_numpy() for c in ("side", "id", "root"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        left = np.arange(len(ids)) if table.column("u")[0] == table.column("v")[0] else np.flatnonzero(~sides)
        right = left if len(left) == len(ids) else np.flatnonzero(sides)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sizes = np.array([len(x) for x in sets])
        both = _shared([sets[i] for i in left], [sets[i] for i in right])
        near = both >= least * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-6
        x, y = np.nonzero(near & (roots[left][:, None] != roots[right][None, :]))
        x, y = left[x], right[y]
        _, first = np.unique(np.stack([np.minimum(roots[x], roots[y]), np.maximum(roots[x], roots[y])]), axis=1,
                             return_index=True)
        return pa.table({"a": pa.array(ids[x][first]), "b": pa.array(ids[y][first])})

    some = broadcast_if_small(units.select("id").distinct())
    sets = stored(docs.join(some, "id", "left_semi").mapInArrow(tidied(hashed), "id long, shingles binary"), "shingles",
                  files_for(docs, 0.2))
    return units.join(sets, "id").groupBy("key", "u", "v").applyInArrow(compare, "a long, b long")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                  least: float = 0.8) -> DataFrame:
    """Links `(a, b)` of documents that connect all pairs with the given similarity found in a common bucket.

    Ids must be unique and not null. Case of ASCII letters and the kind of white space do not count. Texts
    without words have no links. `least` below 0.8 needs more bands.
    """
    docs = id_and_text(docs, id_col, text_col)
    bands = stored(docs.mapInArrow(tidied(lambda batches: _banded(batches, shingle)), BANDED), "bands", files_for(docs, 0.2))
    members = bands.select("id", F.explode("keys").alias("key"))  # a key holds the number of its band
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(members.join(heads, "key").select("key", "id", "head"), "members", files_for(docs, 0.2))
    files = files_for(docs, 0.02)

    def with_root(rows: DataFrame, found: DataFrame, of: str, name: str) -> DataFrame:
        return rows.join(found.toDF(of, name), of, "left").withColumn(name, F.coalesce(name, of))

    others = members.where("id <> head")
    pairs = stored(others.groupBy("id").agg(F.min("head").alias("b")).withColumnRenamed("id", "a"), "pairs", files)
    links = stored(_verified(docs, pairs, shingle, least), "jaccard-links", files)
    found = components(links, links.count())
    apart = with_root(with_root(others, found, "id", "root"), found, "head", "head_root").where("root <> head_root")
    more = stored(apart.select(F.col("id").alias("a"), F.col("head").alias("b")).distinct().join(
        pairs, ["a", "b"], "left_anti"), "pairs", files)
    links = stored(links.union(_verified(docs, more, shingle, least)), "jaccard-links", files)
    grouped = with_root(members, components(links, links.count()), "id", "root")
    mixed = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = stored(grouped.join(mixed.select("key"), "key", "left_semi").select("key", "id", "root"), "mixed", files)
    units = stored(_chunk_units(mixed), "chunk-units", files)
    return links.union(_unit_links(docs, units, shingle, least))
