"""Operators over embedding vectors with cluster labels.

Points are rows `(id, embedding array, cluster_id)`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from postloom.functions.text import tokens
from postloom.session import broadcast_if_small, checkpointed

# Largest centroid table (values) that is held by the driver and every task.
MODEL_VALUES = 8_000_000
BLOCK_ROWS = 2_000
# Vector components and sums of a block of the exact silhouette, which may have more rows than that.
BLOCK_VALUES = 2_000_000
BLOCK_SUMS = 4_000_000


def as_vector(df: DataFrame, vec: str) -> Column:
    """The column as an ML vector."""
    if isinstance(df.schema[vec].dataType, VectorUDT):
        return F.col(vec)
    return array_to_vector(F.col(vec).cast("array<double>"))


def embed(df: DataFrame, text: str = "content", method="tfidf", size: int = 384, min_count: int = 5,
          keep: list[str] | None = None) -> DataFrame:
    """Add an `embedding` array to each row. With `keep` only these columns stay beside it, and `tfidf` writes its
    term frequencies once instead of reading the text for the fit and again for the vectors.

    `tfidf`: hashed term frequencies times inverse document frequency, unit length. `word2vec`: mean word
    vector, trained in one task per input partition; words seen fewer than `min_count` times are left out, and
    the vocabulary (a vector of `size` for each word) must fit the driver. A callable maps an iterator of pandas text series to an iterator of lists of vectors; it is
    called once per task, so a model it loads first serves all its batches.
    """
    if callable(method):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in method(batches):
                yield pd.Series([[float(v) for v in row] for row in vectors])

        encode = F.pandas_udf(run, "array<float>")
        done = df.withColumn("embedding", encode(F.col(text)))
        return done.select(*keep, "embedding") if keep else done
    words = df.withColumn("_words", tokens(F.col(text)))
    if method == "tfidf":
        counted = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf").transform(words)
        if keep:
            counted = checkpointed(counted.select(*keep, "_tf"))
        weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counted.select("_tf")).transform(counted)
        encoded = Normalizer(inputCol="_idf", outputCol="_vec").transform(weighted)
    elif method == "word2vec":
        model = Word2Vec(vectorSize=size, minCount=min_count, numPartitions=words.rdd.getNumPartitions(), seed=42,
                         inputCol="_words", outputCol="_vec")
        encoded = model.fit(words.select("_words")).transform(words)
    else:
        raise ValueError(f"unknown embedding method {method!r}")
    return encoded.select(*(keep or df.columns), vector_to_array("_vec", "float32").alias("embedding"))


def cluster_moments(points: DataFrame, vec: str = "embedding") -> DataFrame:
    """Size, mean vector and summed squared distance to the mean per cluster, in one aggregation.

    Map tasks combine first, so the shuffle carries one small row per task and cluster.
    """
    summary = Summarizer.metrics("mean", "variance").summary(as_vector(points, vec)).alias("_m")
    rows = points.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), summary)
    spread = F.aggregate(vector_to_array("_m.variance"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("cluster_id", "n", vector_to_array("_m.mean").alias("center"),
                       (spread * (F.col("n") - 1)).alias("cost"))


def centroids(points: DataFrame, vec: str = "embedding") -> DataFrame:
    return cluster_moments(points, vec).select("cluster_id", "center")


def cluster_cost(points: DataFrame, vec: str = "embedding") -> DataFrame:
    """Summed squared distance of the points to the mean of their cluster."""
    return cluster_moments(points, vec).select("cluster_id", "n", "cost")


def _nearest_finder() -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The function tasks run; made here, it travels with them and needs no package on the workers."""
    def nearest(vectors: np.ndarray, ids: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Distances equal to nine places go to the smaller id (ids ascend). One centre at a time against the
        # best so far: memory is a few numbers per vector, whatever the number of centres.
        best, least = np.zeros(len(vectors), int), np.full(len(vectors), np.inf)
        rounded = least.copy()
        for i, c in enumerate(centers):
            dist = np.sqrt(((vectors - c) ** 2).sum(axis=1))
            near = np.round(dist, 9)
            closer = near < rounded
            best[closer], least[closer], rounded[closer] = i, dist[closer], near[closer]
        return ids[best], least

    return nearest


def fits_model(n_centers: int, dims: int) -> bool:
    return n_centers * dims <= MODEL_VALUES


def assign_nearest(points: DataFrame, centers: DataFrame, vec: str = "embedding") -> DataFrame:
    """Nearest centroid of every point: `(id, cluster_id, distance)`.

    A centroid table up to `MODEL_VALUES` values travels with the tasks and the points are not shuffled;
    a larger one is split into blocks that are compared with blocks of points, each pair in its own task.
    """
    centers = checkpointed(centers)  # read twice below; an aggregation over all points may stand behind it
    size = centers.select(F.size("center").alias("d")).agg(F.count(F.lit(1)).alias("k"), F.max("d").alias("d")).first()
    if size["k"] == 0:
        raise ValueError("no centroids")
    if fits_model(size["k"], size["d"]):
        rows = centers.orderBy("cluster_id").collect()  # at most MODEL_VALUES values
        ids = np.array([r["cluster_id"] for r in rows])
        table = np.array([r["center"] for r in rows], dtype=float)
        find = _nearest_finder()

        @F.pandas_udf("cluster_id int, distance double")
        def nearest(vectors: pd.Series) -> pd.DataFrame:
            found, dist = find(np.stack(vectors.to_list()).astype(float), ids, table)
            return pd.DataFrame({"cluster_id": found.astype("int32"), "distance": dist})

        return points.select("id", nearest(F.col(vec)).alias("_hit")).select("id", "_hit.*")
    n_blocks = math.ceil(size["k"] * size["d"] / MODEL_VALUES)
    return _assign_by_blocks(points, centers, vec, n_blocks)


def _numbers(n: int) -> Column:
    """The numbers 0 to n - 1, typed like a block number."""
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _assign_by_blocks(points: DataFrame, centers: DataFrame, vec: str, center_blocks: int) -> DataFrame:
    """Exact assignment for any number of centroids: best per centroid block, then best of those."""
    point_blocks = max(1, math.ceil(points.count() / BLOCK_ROWS))
    left = points.select(
        F.pmod(F.xxhash64("id"), F.lit(point_blocks)).alias("a"),
        F.explode(_numbers(center_blocks)).alias("b"), "id",
        F.col(vec).cast("array<double>").alias("v"))
    right = centers.select(
        F.explode(_numbers(point_blocks)).alias("a"),
        F.pmod(F.xxhash64("cluster_id"), F.lit(center_blocks)).alias("b"), "cluster_id",
        F.col("center").cast("array<double>").alias("v"))
    id_type = points.schema["id"].dataType.simpleString()
    find = _nearest_finder()

    def best(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or table.empty:
            return pd.DataFrame({"id": [], "cluster_id": [], "distance": []})
        table = table.sort_values("cluster_id")
        found, dist = find(np.stack(rows["v"].to_list()), table["cluster_id"].to_numpy(),
                               np.stack(table["v"].to_list()))
        return pd.DataFrame({"id": rows["id"].to_numpy(), "cluster_id": found, "distance": dist})

    partial = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(
        best, f"id {id_type}, cluster_id int, distance double")
    pick = F.min(F.struct(F.round("distance", 9).alias("r"), "cluster_id", "distance")).alias("_m")
    return partial.groupBy("id").agg(pick).select("id", "_m.cluster_id", "_m.distance")


def assign_new(points: DataFrame, vec: str = "embedding") -> DataFrame:
    """Nearest existing cluster for the points that have none yet."""
    return assign_nearest(points.where("cluster_id is null"), centroids(points, vec), vec)


def small_cluster_moves(points: DataFrame, min_size: int, vec: str = "embedding") -> DataFrame:
    """`(cluster_id, target)`: for each cluster below `min_size` the nearest one that is not.

    Distances are between centroids. There are no rows where no cluster is large enough.
    """
    moments = checkpointed(cluster_moments(points, vec))  # one row per cluster, read twice
    large = moments.where(F.col("n") >= min_size).select("cluster_id", "center")
    small = moments.where(F.col("n") < min_size).select(F.col("cluster_id").alias("id"), "center")
    if large.isEmpty():
        return small.select(F.col("id").alias("cluster_id"), F.col("id").alias("target")).where(F.lit(False))
    return assign_nearest(small, large, "center").select(
        F.col("id").alias("cluster_id"), F.col("cluster_id").alias("target"))


def move_clusters(labelled: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows with their cluster replaced by its target, where it has one."""
    targets = moves.select(F.col("cluster_id").alias("_from"), F.col("target").alias("_to"))
    moved = labelled.join(broadcast_if_small(targets), F.col("cluster_id") == F.col("_from"), "left")
    return moved.withColumn("cluster_id", F.coalesce("_to", "cluster_id")).select(*labelled.columns)


def reassign_small(points: DataFrame, min_size: int = 3, vec: str = "embedding") -> DataFrame:
    """`(id, cluster_id)` after clusters below `min_size` are merged into the nearest larger one."""
    return move_clusters(points.select("id", "cluster_id"), small_cluster_moves(points, min_size, vec))


def _distance_tiles() -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[slice, slice, np.ndarray]]]:
    """The function tasks run; made here, it travels with them and needs no package on the workers."""
    def direct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - y) ** 2).sum(axis=-1))

    def tiles(x: np.ndarray, y: np.ndarray, high: int = 128, wide: int = 1024
              ) -> Iterator[tuple[slice, slice, np.ndarray]]:
        # |x|^2 + |y|^2 - 2xy by one matrix product, about a common middle. Where that difference is too small to be
        # exact, or a vector has no finite square, the distance is worked out from the components.
        with np.errstate(all="ignore"):
            usual = np.abs(x).max(axis=1, initial=0) < 1e100
            middle = x[usual].mean(axis=0) if usual.any() else 0.0
            x, y = x - middle, y - middle
            odd_x, odd_y = (~(np.abs(m).max(axis=1, initial=0) < 1e100) for m in (x, y))
            xs, ys = np.where(odd_x[:, None], 0.0, x), np.where(odd_y[:, None], 0.0, y)
            xx, yy, across = (xs * xs).sum(axis=1), (ys * ys).sum(axis=1), -2.0 * ys.T
            for j in range(0, len(y), wide):
                cols = slice(j, j + wide)
                for i in range(0, len(x), high):
                    rows = slice(i, i + high)
                    dist = xs[rows] @ across[:, cols]
                    dist += xx[rows, None]
                    dist += yy[cols]
                    close = np.nonzero((dist < (1e-6 * (xx[rows] + yy[cols].max()))[:, None]).ravel())[0]
                    np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
                    for k in range(0, len(close), 1 << 14):
                        at = np.divmod(close[k:k + (1 << 14)], dist.shape[1])
                        dist[at] = direct(x[rows][at[0]], y[cols][at[1]])
                    for k in np.flatnonzero(odd_x[rows]):
                        dist[k] = direct(x[i + k], y[cols])
                    for k in np.flatnonzero(odd_y[cols]):
                        dist[:, k] = direct(x[rows], y[j + k])
                    yield rows, cols, dist

    return tiles


def silhouettes(points: DataFrame, labels: list[str], vec: str = "embedding",
                block_rows: int | None = None) -> DataFrame:
    """Exact Euclidean silhouette `(id, labelling, cluster_id, silhouette)` under one or several labellings.

    A labelling is an integer column, numbered by its place in `labels`; a point in a cluster of one scores 0.
    Points are spread over blocks by hash. Every pair of blocks is one task that works out the distances
    by matrix products, a tile at a time and once for all labellings, and returns per point and cluster only their
    sum; no row per pair of points exists. Each point is sent to every block, so the blocks are as large as the
    vectors and sums of two of them may be (`BLOCK_VALUES`, `BLOCK_SUMS`), but not so large that cores are left
    without a pair. The work is quadratic by definition: see `clustering.silhouette_fast` for large tables.
    """
    marks = F.array(*[F.col(c).cast("int") for c in labels])
    plain = points.schema[vec].dataType.simpleString() in ("array<float>", "array<double>")
    rows = points.select("id", marks.alias("c"), (F.col(vec) if plain else F.col(vec).cast("array<double>")).alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.array(*[
        F.approx_count_distinct(F.col("c")[i]) for i in range(len(labels))]).alias("used")).first()
    if block_rows is None:
        most = min(BLOCK_VALUES // max(1, size["d"] or 0), BLOCK_SUMS // max(1, sum(size["used"])))
        pairs = 3 * points.sparkSession.sparkContext.defaultParallelism
        block_rows = max(BLOCK_ROWS, min(most, math.ceil(size["n"] / (math.isqrt(2 * pairs) + 1))))
    blocks = max(1, math.ceil(size["n"] / block_rows))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # A pair (a, b) with a <= b serves both directions.
    upper = placed.select(F.col("block").alias("a"),
                          F.explode(F.sequence("block", F.lit(blocks - 1))).alias("b"), "id", "c", "v")
    lower = placed.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("a"),
                          F.col("block").alias("b"), "id", "c", "v")
    field = points.schema["id"]
    out = StructType([StructField("id", field.dataType)]).add("labelling", "integer").add("own", "integer").add(
        "other", "integer").add("total", "double").add("n", "double")
    tiles = _distance_tiles()
    n_labels = len(labels)

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        if lists.null_count or pc.min_max(lists.value_lengths())["min"] != pc.min_max(lists.value_lengths())["max"]:
            raise ValueError("all vectors must be given and have the same length")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(lists), -1)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema([pa.field("id", left.schema.field("id").type), ("labelling", pa.int32()), ("own", pa.int32()),
                           ("other", pa.int32()), ("total", pa.float64()), ("n", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        same = left["a"][0] == right["b"][0]
        sides = []
        for table in (left, right):
            used = table["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_labels)
            sides.append((table, [np.unique(used[:, w], return_inverse=True) for w in range(n_labels)]))
        totals = [[np.zeros((mine.num_rows, len(names))) for names, _ in theirs]
                  for (mine, _), (_, theirs) in (sides, sides[::-1])]

        def members(side: int, part: slice) -> list[tuple[np.ndarray, np.ndarray]]:
            """Per labelling, the clusters that some rows of a side are in, and which row is in which."""
            found = []
            for _, codes in sides[side][1]:
                at, local = np.unique(codes[part], return_inverse=True)
                found.append((at, (local[:, None] == np.arange(len(at))).astype(float)))
            return found

        columns, theirs, mine = None, [], {}
        for across, down, dist in tiles(matrix(left["v"]), matrix(right["v"])):
            if down != columns:
                columns, theirs = down, members(1, down)
            for w, (at, member) in enumerate(theirs):
                totals[0][w][across, at] += dist @ member
            if not same:
                if across.start not in mine:
                    mine[across.start] = members(0, across)
                for w, (at, member) in enumerate(mine[across.start]):
                    totals[1][w][down, at] += dist.T @ member
        parts = []
        for side in range(1 if same else 2):
            (table, mine), (_, theirs) = sides[side], sides[1 - side]
            ids = table["id"].combine_chunks()
            for w, (names, codes) in enumerate(theirs):
                each = np.repeat(np.arange(len(ids)), len(names))
                n = np.bincount(codes, minlength=len(names)).astype(float)
                own = mine[w][0][mine[w][1]]
                parts.append(pa.Table.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.full(len(each), w, np.int32)),
                    pa.array(own[each].astype(np.int32)), pa.array(np.tile(names, len(ids)).astype(np.int32)),
                    pa.array(totals[side][w].ravel()), pa.array(np.tile(n, len(ids)))], schema=shape))
        return pa.concat_tables(parts)

    partial = upper.groupBy("a", "b").cogroup(lower.groupBy("a", "b")).applyInArrow(sums, out)
    keys = ["id", "labelling", "own"]
    per_cluster = partial.groupBy(*keys, "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("other") == F.col("own")
    scored = per_cluster.groupBy(*keys).agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("within"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("beside"))
    width = F.greatest("within", "beside")
    score = F.when((F.col("size") > 1) & (width > 0), (F.col("beside") - F.col("within")) / width).otherwise(0.0)
    return scored.select("id", "labelling", F.col("own").alias("cluster_id"), score.alias("silhouette"))


def silhouette_exact(points: DataFrame, vec: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Mean exact silhouette, one row."""
    scored = silhouettes(points.where("cluster_id is not null"), ["cluster_id"], vec, block_rows)
    return scored.agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n"))
