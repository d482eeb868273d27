"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, in order. Each vector stands in the inverted lists
of these pivots; vectors that share one are candidates, and their cosine is computed in double precision.
A pair that meets in several lists counts in the list of the first pivot it shares.

Pivots lie apart from one another, so a dense group has one or a few of them however many rows it has, and its
members do not spread over them. A description leaves out only pivots that cannot be the nearest of any vector
within reach; where the others are `NEAREST` at most, no link of the vector can be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import column, files_for, stored
from postloom.llm.components import components

#: Members of a list compared in one piece; longer lists are cut into pairs of chunks.
CHUNK = 1024

#: Pivots in the description of a vector at most.
NEAREST = 10

#: The least distance of two pivots, in distances of a pair that just links.
APART = 3

#: The index is fitted on this many rows at most: they are the pivots. Few vectors need fewer.
MOST_PIVOTS, LEAST_PIVOTS = 4096, 128


def choose_pivots(vectors: DataFrame, n: int, apart: float = 0) -> np.ndarray:
    """A bounded pseudorandom sample of the vectors, as unit vectors in rows, less those nearer to an earlier one."""
    rows = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n).collect()
    found = np.array([r["vec"] for r in rows], float)
    found = found / np.linalg.norm(found, axis=1, keepdims=True)
    kept, size = np.empty_like(found), 0
    for row in found:
        if not size or (kept[:size] @ row).max() <= 1 - apart * apart / 2:
            kept[size] = row
            size += 1
    return kept[:size]


def described(vec: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the nearest pivots of each vector, nearest first, and which of them count.

    A vector whose nearest pivot is q lies on q's side of the plane between q and p. So q counts for a vector
    with nearest pivot p only if that plane is at most `reach` away from it.
    """
    most = min(NEAREST, len(pivots))
    near = (vec / np.linalg.norm(vec, axis=1, keepdims=True)) @ pivots.T
    top = np.argpartition(-near, most - 1, axis=1)[:, :most]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    near = np.take_along_axis(near, top, 1)
    between = np.linalg.norm(pivots[top] - pivots[top[:, :1]], axis=2)
    return top, near[:, :1] - near <= reach * between + 1e-9


def _described(vectors: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """The pivots that describe each vector, nearest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            vec = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
            top, counts = described(vec, shared.value, reach)
            cuts = pa.array(np.concatenate([[0], np.cumsum(counts.sum(1))]), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.array(top[counts], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "near"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{columns}, near array<int>")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 least: float = 0.98, pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """`id, n_links, component_id, kept` of every row: links to vectors of its label with cosine >= `least`.

    Only vectors with an id, a label, at least one component, and components that are finite, not null and
    not all zero take part; the others have no links and are their own component. Equal vectors of a label
    are one member of the index with a weight. Vectors of different length never link. Repeated rows count
    as separate vectors. An empty table gives no rows.
    """
    rows = vectors.select(column(id_col).cast("bigint").alias("id"), column(label_col).alias("label"),
                          column(vec_col).cast("array<double>").alias("vec"))
    good = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)
            & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    classes = stored(rows.where(F.coalesce(good, F.lit(False))).groupBy("label", "vec").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "vector-classes", files_for(vectors, 2))
    sizes = classes.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()
    links = None
    for dims, n in sorted(tuple(r) for r in sizes):  # one length in any sane table
        some = _links(classes.where(F.size("vec") == dims), n, least, pivots, chunk)
        links = some if links is None else links.unionByName(some)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    links = stored(links, "vector-links", files_for(vectors, 0.5))
    found = components(links.select("a", "b"), links.count())
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    verdict = (classes.join(counts, "id", "left").join(found, "id", "left").select(
        "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id")))
    usable = rows.withColumn("usable", F.coalesce(good, F.lit(False)))
    # Rows that take no part have a key of their own, so that they do not meet in one task.
    alone = usable.where(~F.col("usable")).select("id", F.lit(0).cast("bigint").alias("n_links"),
                                                  F.col("id").alias("component_id"))
    linked = usable.where("usable").join(verdict, ["label", "vec"]).select("id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, n: int, least: float, pivots: int | None, chunk: int) -> DataFrame:
    """`a, b, n`: a member's links in a list (by weight) and the member it is joined to there."""
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << (int(n ** 0.5)).bit_length()))
    reach = max(0.0, 2 - 2 * least) ** 0.5
    found = choose_pivots(classes, pivots, APART * reach)
    members = stored(_described(classes.select("id", "label", "weight", "vec"), found, reach),
                     "described-vectors", files_for(classes, 1.2))
    lists = members.select("*", F.explode("near").alias("pivot"))
    sizes = lists.groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.where("size > 1").withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    units = (lists.join(sizes, ["label", "pivot"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("label", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "id", "weight", "vec", "near"))

    def run(table: pa.Table) -> pa.Table:
        pivot, i, j = (table.column(k)[0].as_py() for k in ("pivot", "i", "j"))
        ids, weight, side = (table.column(k).to_numpy() for k in ("id", "weight", "own"))
        vec = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        vec = vec / np.linalg.norm(vec, axis=1, keepdims=True)
        near = table.column("near").combine_chunks()
        of = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy())
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        seen, place = np.unique(near.flatten().to_numpy(), return_inverse=True)
        marks = np.zeros((len(ids), len(seen)), np.float32)
        marks[of, place] = 1
        early = int(np.searchsorted(seen, pivot))
        pairs = marks[left][:, :early] @ marks[right][:, :early].T == 0
        pairs &= vec[left] @ vec[right].T >= least
        if i == j:
            np.fill_diagonal(pairs, False)
        links = np.zeros(len(ids), np.int64)
        links[left] += pairs @ weight[right]
        if i != j:
            links[right] += weight[left] @ pairs
        # The smallest member reachable inside the list, by label propagation over its pairs.
        root = ids.copy()
        joined = pairs.any()
        while joined:
            low = np.where(pairs, root[right][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
            new = root.copy()
            new[left] = np.minimum(new[left], low)
            if i != j:
                low = np.where(pairs, new[left][:, None], np.iinfo(np.int64).max).min(0)
                new[right] = np.minimum(new[right], low)
            joined, root = not np.array_equal(new, root), new
        hit = links > 0
        return pa.table({"a": pa.array(ids[hit]), "b": pa.array(root[hit]), "n": pa.array(links[hit])})

    return units.groupBy("label", "pivot", "i", "j").applyInArrow(run, "a long, b long, n long")
