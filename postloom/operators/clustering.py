"""K-means clustering of posts with automatic choice of k."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.keywords import describe_clusters
from postloom.operators.vectors import as_vector, embed, move_clusters, silhouettes, small_cluster_moves
from postloom.session import checkpointed

# Seed, restarts and bounds of the search for k.
SEED = 42
RESTARTS = 10
MAX_ITER = 300
MAX_AUTO_K = 20
TOLERANCE = 1e-4
# Rows of sums that the driver adds up itself.
MAX_SUMS = 64
# Fits of up to this many points run side by side.
PARALLEL_FITS = 4
PARALLEL_POINTS = 1_000_000


def bound_k(k: int, n: int) -> int:
    return max(2, min(k, n - 1))


def auto_k_bound(n: int) -> int:
    return max(2, min(math.isqrt(n), MAX_AUTO_K))


def _features(points: DataFrame, vec: str) -> DataFrame:
    return points.select("id", as_vector(points, vec).alias("features"))


def _side_by_side(points: DataFrame, n: int, tasks: list[Callable[[], KMeansModel]]) -> list[KMeansModel]:
    """Run independent fits of few points at the same time, as Spark's own model selection does.

    A fit of many points keeps the cluster busy by itself.
    """
    if n > PARALLEL_POINTS:
        return [task() for task in tasks]
    with ThreadPool(min(PARALLEL_FITS, len(tasks))) as pool:
        return pool.map(lambda task: inheritable_thread_target(points.sparkSession)(task)(), tasks)


def _fit(features: DataFrame, k: int, seed: int, max_iter: int) -> KMeansModel:
    # Blocks of rows are made once and multiplied with all centres; without iterations they would serve nothing.
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", solver="block" if max_iter else "row").fit(
        features)


def fit_kmeans(features: DataFrame, k: int, n_init: int = RESTARTS, seed: int = SEED,
               max_iter: int = MAX_ITER) -> KMeansModel:
    """The model of lowest cost over `n_init` seeds.

    `features` should be persisted by the caller: the fits read that copy and make none of their own.
    """
    starts = [partial(_fit, features, k, seed + start, max_iter) for start in range(n_init)]
    return min(_side_by_side(features, features.count(), starts), key=lambda model: model.summary.trainingCost)


def label(model: KMeansModel, features: DataFrame) -> DataFrame:
    """`cluster_id`, from 1, in place of the features."""
    labelled = model.transform(features).withColumn("cluster_id", (F.col("prediction") + 1).cast("int"))
    return labelled.drop("prediction", "features")


def kmeans(points: DataFrame, k: int, n_init: int = RESTARTS, seed: int = SEED,
           vec: str = "embedding") -> DataFrame:
    """`(id, cluster_id)` of every point."""
    features = _features(points, vec).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_kmeans(features, k, n_init, seed)
    finally:
        features.unpersist()
    return label(model, _features(points, vec))


def _nearest_of_starts(starts: list[np.ndarray]) -> Callable[[np.ndarray], Iterator[tuple]]:
    """The function tasks run; made here, it travels with them and needs no package on the workers."""
    middle = starts[0].mean(axis=0)
    centers = np.concatenate(starts) - middle
    squares, first = (centers * centers).sum(axis=1), np.cumsum([0, *map(len, starts)])

    def nearest(vectors: np.ndarray, step: int = 4096) -> Iterator[tuple]:
        # Rows about the middle, and for each start the nearest centre (the first of equal ones) and its squared distance.
        for at in range(0, len(vectors), step):
            x = vectors[at:at + step] - middle
            dist = x @ (-2.0 * centers.T) + squares
            of_start = [dist[:, a:b] for a, b in zip(first, first[1:], strict=False)]
            found = np.stack([d.argmin(axis=1) for d in of_start], axis=1)
            least = np.stack([d.min(axis=1) for d in of_start], axis=1) + (x * x).sum(axis=1)[:, None]
            yield x, found, np.maximum(least, 0.0)

    return nearest


def _pass(vectors: DataFrame, starts: list[np.ndarray], n_tasks: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each start the number of points nearest to each centre, their mean and the summed squared distance."""
    nearest, dims = _nearest_of_starts(starts), starts[0].shape[1]
    middle, first = starts[0].mean(axis=0), np.cumsum([0, *map(len, starts)])
    size = int(first[-1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cost = np.zeros((size, dims + 1)), np.zeros(len(first) - 1)
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                for x, found, least in nearest(flat.reshape(batch.num_rows, dims)):
                    member = np.zeros((len(x), size))
                    np.put_along_axis(member, found + first[:-1], 1.0, axis=1)
                    total[:, :dims] += member.T @ x
                    total[:, dims] += member.sum(axis=0)
                    cost += least.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes() + cost.tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (dims + 1) + len(first) - 1)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer())
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    # One row of sums per task; those of many tasks are added up by a few before they go to the driver.
    rows = vectors.mapInArrow(sums, "sums binary")
    if n_tasks > MAX_SUMS:
        rows = rows.repartition(MAX_SUMS // 4).mapInArrow(added, "sums binary")
    whole = sum(np.frombuffer(row["sums"]) for row in rows.collect())
    table, cost = whole[:size * (dims + 1)].reshape(size, dims + 1), whole[size * (dims + 1):]
    with np.errstate(invalid="ignore"):
        means = table[:, :dims] / table[:, dims:] + middle
    return [(table[a:b, dims], means[a:b], float(c)) for a, b, c in zip(first, first[1:], cost, strict=False)]


def fit_starts(features: DataFrame, starts: list[np.ndarray], max_iter: int = MAX_ITER,
               tol: float = TOLERANCE) -> list[tuple[np.ndarray, float]]:
    """K-means from several tables of first centres at once: the last centres and the cost of each.

    Each pass over the points moves the centres of every start that has not settled, by the rules by which Spark's
    `KMeans` moves those of one: a centre without points stays, and a start has settled when no centre moved by more
    than `tol`. So there are as many passes as the slowest start needs, not as many as all of them together.
    """
    vectors = features.select(vector_to_array("features").alias("v"))
    n_tasks = vectors.rdd.getNumPartitions()
    centers, cost, moving = list(starts), [0.0] * len(starts), list(range(len(starts)))
    for _ in range(max_iter):
        if not moving:
            break
        found = _pass(vectors, [centers[i] for i in moving], n_tasks)
        still = []
        for i, (n, means, total) in zip(moving, found, strict=True):
            new = np.where(n[:, None] > 0, means, centers[i])
            if (((new - centers[i]) ** 2).sum(axis=1) > tol * tol).any():
                still.append(i)
            centers[i], cost[i] = new, total
        moving = still
    return list(zip(centers, cost, strict=True))


def label_starts(features: DataFrame, starts: list[np.ndarray], name: str = "labels") -> DataFrame:
    """The features with an array of the nearest centre in each table of centres."""
    nearest = _nearest_of_starts(starts)

    @F.pandas_udf("array<int>")
    def labels(vectors: pd.Series) -> pd.Series:
        found = [rows for _, rows, _ in nearest(np.stack(vectors.to_list()))] if len(vectors) else []
        return pd.Series([row for rows in found for row in rows.astype("int32")], dtype=object)

    return features.withColumn(name, labels(vector_to_array("features")))


def silhouette_fast(points: DataFrame, label_col: str = "cluster_id", vec: str = "embedding") -> float:
    """Mean silhouette with squared Euclidean distances: linear in the number of points."""
    rows = points.where(F.col(label_col).isNotNull()).select(
        as_vector(points, vec).alias("features"), F.col(label_col).cast("int").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows)


def sweep_k(points: DataFrame, vec: str = "embedding", n_init: int = 1, seed: int = SEED,
            silhouette: str = "squared") -> list[tuple[int, float]]:
    """Silhouette of every candidate k from 2 to the bound; candidates with a single label are left out.

    `silhouette` names the measure, at every size: "squared" is the squared Euclidean one, linear in the
    number of points; "exact" the Euclidean one, quadratic, with distances shared by all candidates.
    """
    if silhouette not in ("squared", "exact"):
        raise ValueError("silhouette is 'squared' or 'exact'")
    own_copy = not (points.is_cached and vec == "features")
    features = _features(points, vec).persist(StorageLevel.MEMORY_AND_DISK) if own_copy else points
    try:
        n = features.count()
        # Spark's own choice of the first centres; all candidates then share each pass over the points.
        fits = [partial(_fit, features, k, seed + start, 0)
                for k in range(2, auto_k_bound(n) + 1) for start in range(n_init)]
        tried = [(model.getK(), np.array(model.clusterCenters())) for model in _side_by_side(features, n, fits)]
        best: dict[int, tuple[np.ndarray, float]] = {}
        for (k, _), (centers, cost) in zip(tried, fit_starts(features, [c for _, c in tried]), strict=True):
            if k not in best or cost < best[k][1]:
                best[k] = centers, cost
        labelled = label_starts(features, [centers for centers, _ in best.values()])
        labelled = labelled.withColumns({f"k{k}": F.col("labels")[i] for i, k in enumerate(best)}).drop("labels").persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            used = labelled.agg(*[(F.min(f"k{k}") < F.max(f"k{k}")).alias(f"k{k}") for k in best]).first()
            candidates = [k for k in best if used[f"k{k}"]]
            if not candidates:
                return []
            columns = [f"k{k}" for k in candidates]
            if silhouette == "squared":
                return [(k, silhouette_fast(labelled, f"k{k}", "features")) for k in candidates]
            arrays = labelled.withColumn("embedding", vector_to_array("features"))
            means = silhouettes(arrays, columns).groupBy("labelling").agg(F.avg("silhouette").alias("mean"))
            found = {row["labelling"]: row["mean"] for row in means.collect()}  # one row per candidate
            return [(k, found[i]) for i, k in enumerate(candidates)]
        finally:
            labelled.unpersist()
    finally:
        if own_copy:
            features.unpersist()


def best_k(scores: list[tuple[int, float]]) -> int:
    """Highest score above -1, the smallest k on a tie; 2 if there is none."""
    best, best_score = 2, -1.0
    for k, score in sorted(scores):
        if score > best_score:
            best, best_score = k, score
    return best


def auto_k(points: DataFrame, vec: str = "embedding", n_init: int = 1, seed: int = SEED,
           silhouette: str = "squared") -> int:
    """Number of clusters with the best silhouette."""
    return best_k(sweep_k(points, vec, n_init, seed, silhouette))


def cluster_posts(posts: DataFrame, k: int | None = None, min_posts: int = 6, vectors: DataFrame | None = None,
                  method="tfidf", stop: list[str] | None = None, n_init: int = RESTARTS, seed: int = SEED,
                  min_size: int | None = None, silhouette: str = "squared", auto_n_init: int = 1,
                  missing: str = "raise") -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """Cluster posts: `(assignments, clusters)`, or two Nones below `min_posts`.

    `vectors` gives precomputed embeddings by id; otherwise the text is embedded with `method`, once. Posts
    without a given vector raise an error with their number, or with `missing="null"` are assigned no cluster.
    With `min_size`, smaller clusters are merged into the nearest larger one. `silhouette` and `auto_n_init`
    (restarts per candidate k) as in `sweep_k`.
    """
    # Written once: the posts may stand behind joins, and their text is read for the vectors and for the keywords.
    rows = checkpointed(posts.select("id", "content"))
    if rows.limit(min_posts).count() < min_posts:
        return None, None
    # Embedded once and written: the fits, the labels and the sizes below agree whatever the embedder does.
    points = checkpointed((embed(rows, method=method, keep=["id"]) if vectors is None else rows.join(
        vectors.select("id", "embedding"), "id", "left")).select("id", "embedding"))
    without = points.where("embedding is null").select("id")
    if vectors is not None and missing != "null" and (n := without.count()):
        raise ValueError(f"{n} posts have no vector")
    points = points.where("embedding is not null")
    features = _features(points, "embedding").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = features.count()
        if n < 2:
            return None, None
        chosen = k if k is not None else auto_k(features, "features", auto_n_init, seed, silhouette)
        chosen = bound_k(chosen, n)
        model = fit_kmeans(features, chosen, n_init, seed)
        labelled = label(model, features.withColumn("vector", F.col("features")))
        moves = checkpointed(small_cluster_moves(labelled, min_size, "vector")) if min_size else None
        labelled = labelled.select("id", "cluster_id")
        assignments = checkpointed(move_clusters(labelled, moves) if min_size else labelled)
    finally:
        features.unpersist()
    ids = posts.sparkSession.range(1, chosen + 1).select(F.col("id").cast("int").alias("cluster_id"))
    if min_size:
        ids = ids.join(moves.select("cluster_id"), "cluster_id", "left_anti")
        chosen = ids.count()
    clusters = describe_clusters(rows.join(assignments, "id"), ids, stop, n_clusters=chosen)
    if vectors is not None:
        assignments = assignments.unionByName(without.withColumn("cluster_id", F.lit(None).cast("int")))
    return assignments, clusters.withColumn("created_at", F.current_timestamp())
