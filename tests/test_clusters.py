import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from postloom.operators import clustering as C
from postloom.operators import keywords as K
from postloom.operators import vectors as V

TOPICS = ["remote interviews onboarding mentors payroll note {}",
          "kernel scheduler latency compiler cache note {}",
          "bread flour oven yeast butter note {}"]


@pytest.fixture
def topic_posts(spark):
    def make(topics, each):
        rows = [(f"t{t}-{i}", TOPICS[t].format(i)) for t in range(topics) for i in range(each)]
        return spark.createDataFrame(rows, "id string, content string")

    return make


@pytest.fixture
def cloud(spark):
    """Random points with very uneven labels, among them a cluster of one and two equal points."""
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 5))
    vecs[1] = vecs[0]
    labels = [1] * 40 + [2] * 19 + [3]
    rows = [(i, [float(x) for x in v], c) for i, (v, c) in enumerate(zip(vecs, labels))]
    return vecs, labels, spark.createDataFrame(rows, "id bigint, embedding array<double>, cluster_id int")


def brute_silhouette(vecs, labels):
    dist = np.sqrt(((vecs[:, None] - vecs[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        members = {c: [j for j, x in enumerate(labels) if x == c and j != i] for c in set(labels)}
        if not members[own]:
            scores.append(0.0)
            continue
        a = dist[i, members[own]].mean()
        b = min(dist[i, m].mean() for c, m in members.items() if c != own)
        scores.append((b - a) / max(a, b))
    return scores


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_silhouette_blocks(cloud, block_rows):
    vecs, labels, points = cloud
    got = {r["id"]: r["silhouette"] for r in V.silhouettes(points, ["cluster_id"], block_rows=block_rows).collect()}
    assert np.allclose([got[i] for i in range(60)], brute_silhouette(vecs, labels))


def test_distances_by_matrix_products_are_exact():
    """Near copies, vectors far from the origin and vectors without a finite length, in tiles of all shapes."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    x[1], x[2], x[3] = x[0], x[0] + 1e-9, x[0] + 1e-5
    x = x + 1000
    x[4, 1], x[5, 0], x[6] = np.nan, np.inf, x[6] * 1e200
    with np.errstate(all="ignore"):
        want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for shape in ((7, 11), (64, 64)):
        got = np.zeros_like(want)
        for rows, cols, dist in V._distance_tiles()(x, x, *shape):
            got[rows, cols] = dist
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_silhouette_sends_points_to_few_blocks(spark, monkeypatch):
    """The number of blocks follows from what two of them hold, not from a fixed number of rows."""
    points = spark.range(24_000).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"),
                                        F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("cluster_id"))

    def blocks():
        plan = V.silhouettes(points, ["cluster_id"])._jdf.queryExecution().optimizedPlan().toString()
        return int(re.search(r"pmod\(xxhash64\(id#\d+L?, 42\), (\d+)\)", plan)[1])

    few = math.isqrt(6 * spark.sparkContext.defaultParallelism) + 1
    assert blocks() <= few
    monkeypatch.setattr(V, "BLOCK_VALUES", 4_000)
    assert blocks() == 12


def test_silhouettes_of_two_labellings(cloud):
    vecs, labels, points = cloud
    both = points.withColumn("other", (F.col("id") % 4).cast("int"))
    rows = V.silhouettes(both, ["cluster_id", "other"], block_rows=16).groupBy("labelling").agg(
        F.avg("silhouette")).collect()
    got = {r[0]: r[1] for r in rows}
    assert math.isclose(got[0], np.mean(brute_silhouette(vecs, labels)), abs_tol=1e-12)
    assert math.isclose(got[1], np.mean(brute_silhouette(vecs, [i % 4 for i in range(60)])), abs_tol=1e-12)


def test_moments(cloud):
    vecs, labels, points = cloud
    for row in V.cluster_moments(points).collect():
        members = vecs[[i for i, c in enumerate(labels) if c == row["cluster_id"]]]
        assert row["n"] == len(members) and np.allclose(row["center"], members.mean(axis=0))
        assert math.isclose(row["cost"], ((members - members.mean(axis=0)) ** 2).sum(), abs_tol=1e-9)


def test_nearest_by_blocks_equals_model(cloud, monkeypatch):
    _, _, points = cloud
    centers = points.where("id % 3 = 0").select(F.col("id").cast("int").alias("cluster_id"),
                                                 F.col("embedding").alias("center"))
    whole = {r["id"]: (r["cluster_id"], round(r["distance"], 9)) for r in V.assign_nearest(points, centers).collect()}
    monkeypatch.setattr(V, "MODEL_VALUES", 30)
    monkeypatch.setattr(V, "BLOCK_ROWS", 11)
    split = {r["id"]: (r["cluster_id"], round(r["distance"], 9)) for r in V.assign_nearest(points, centers).collect()}
    assert whole == split and len(split) == 60
    assert whole[1] == (0, 0.0)  # points 0 and 1 are equal: the smaller centre wins


def test_reassign_small(cloud):
    vecs, labels, points = cloud
    got = {r["id"]: r["cluster_id"] for r in V.reassign_small(points, 3).collect()}
    means = {c: vecs[[i for i, x in enumerate(labels) if x == c]].mean(axis=0) for c in (1, 2)}
    assert got[59] == min(means, key=lambda c: np.linalg.norm(vecs[59] - means[c]))
    assert [got[i] for i in range(59)] == labels[:59]
    same = {r["id"]: r["cluster_id"] for r in V.reassign_small(points, 100).collect()}
    assert [same[i] for i in range(60)] == labels  # no cluster is large enough


def test_assign_new(cloud):
    _, _, points = cloud
    open_points = points.withColumn("cluster_id", F.when(F.col("id") >= 10, F.col("cluster_id")))
    assert V.assign_new(open_points).count() == 10


def test_embed_callable_gets_batches(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "id string, content string")

    def model(batches):
        for texts in batches:
            yield [[len(t), 1.0] for t in texts]

    got = {r["id"]: list(r["embedding"]) for r in V.embed(rows, method=model).collect()}
    assert got == {"a": [2.0, 1.0], "b": [3.0, 1.0]}
    assert len(V.embed(rows, method="word2vec", size=4, min_count=1).first()["embedding"]) == 4
    with pytest.raises(ValueError):
        V.embed(rows, method="none")


def test_bounds():
    assert [C.bound_k(k, n) for k, n in ((1, 10), (50, 10), (5, 10), (5, 2))] == [2, 9, 5, 2]
    assert [C.auto_k_bound(n) for n in (6, 25, 697, 10_000)] == [2, 5, 20, 20]


def test_best_k():
    assert C.best_k([(2, 0.1), (3, 0.4), (4, 0.4)]) == 3
    assert C.best_k([]) == 2 and C.best_k([(5, -1.0)]) == 2


def test_auto_k_finds_two_groups(spark):
    rows = [(i, [float(i < 12)] * 8) for i in range(25)]
    points = spark.createDataFrame(rows, "id int, embedding array<double>")
    assert C.auto_k(points) == 2
    assert C.auto_k(points, silhouette="exact") == 2


def test_candidates_share_passes_and_equal_single_fits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(300, 4)) + rng.integers(0, 3, (300, 1)) * 4 + 50
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id int, embedding array<double>")
    features = C._features(points.repartition(6), "embedding").persist()
    fits = [KMeans(k=k, seed=C.SEED, maxIter=C.MAX_ITER, featuresCol="features").fit(features) for k in (2, 3, 7)]
    starts = [np.array(C._fit(features, k, C.SEED, 0).clusterCenters()) for k in (2, 3, 7)]
    passes = []
    run = C._pass
    monkeypatch.setattr(C, "_pass", lambda *a: passes.append(1) or run(*a))
    for added_by_the_driver in (64, 4):
        monkeypatch.setattr(C, "MAX_SUMS", added_by_the_driver)
        passes.clear()
        for model, (centers, cost) in zip(fits, C.fit_starts(features, starts), strict=True):
            assert np.allclose(centers, model.clusterCenters())
            assert math.isclose(cost, model.summary.trainingCost, rel_tol=1e-6)
        assert len(passes) == max(m.summary.numIter for m in fits) < sum(m.summary.numIter for m in fits)
    labelled = C.label_starts(features, [np.array(m.clusterCenters()) for m in fits]).orderBy("id").collect()
    want = [[r["prediction"] for r in m.transform(features).orderBy("id").collect()] for m in fits]
    assert [list(r["labels"]) for r in labelled] == [list(x) for x in zip(*want, strict=True)]
    features.unpersist()


def test_cluster_two_topics(topic_posts):
    posts = topic_posts(2, 5)
    assignments, clusters = C.cluster_posts(posts, k=2, n_init=3)
    labels = {r["id"]: r["cluster_id"] for r in assignments.collect()}
    assert len(labels) == 10 and set(labels.values()) == {1, 2}
    rows = clusters.collect()
    assert sorted(r["id"] for r in rows) == [1, 2] and sum(r["post_count"] for r in rows) == 10
    assert all(len(r["keywords"]) == 5 and r["summary"].count(" & ") == 2 for r in rows)


def test_cluster_automatic_k(topic_posts):
    _, clusters = C.cluster_posts(topic_posts(3, 5), n_init=2)
    assert clusters.count() >= 2


def test_cluster_with_given_vectors(spark, topic_posts):
    posts = topic_posts(2, 4)
    vectors = posts.select("id", F.when(F.col("id").startswith("t0"), F.array(F.lit(0.0), F.lit(1.0)))
                           .otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    assignments, _ = C.cluster_posts(posts, k=2, vectors=vectors, n_init=1)
    groups = Counter((r["id"][:2], r["cluster_id"]) for r in assignments.collect())
    assert sorted(groups.values()) == [4, 4]


def test_posts_without_vector_are_not_lost(topic_posts):
    posts = topic_posts(2, 5)
    vectors = posts.where("id not like '%-4'").select("id", F.when(F.col("id").startswith("t0"), F.array(
        F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    with pytest.raises(ValueError, match="2 posts"):
        C.cluster_posts(posts, k=2, vectors=vectors, n_init=1)
    assignments, _ = C.cluster_posts(posts, k=2, vectors=vectors, n_init=1, missing="null")
    found = {r["id"]: r["cluster_id"] for r in assignments.collect()}
    assert len(found) == 10 and [i for i, c in sorted(found.items()) if c is None] == ["t0-4", "t1-4"]


def test_each_text_is_embedded_once(spark, topic_posts):
    seen = spark.sparkContext.accumulator(0)

    def method(batches):
        for texts in batches:
            seen.add(len(texts))
            yield [[float("oven" in t), float("kernel" in t), len(t) / 1000] for t in texts]

    _, clusters = C.cluster_posts(topic_posts(3, 5), k=3, method=method, n_init=2)
    assert clusters.agg(F.sum("post_count")).first()[0] == 15 and seen.value == 15


def test_posts_are_read_once(spark, topic_posts):
    """The fit of the term weights, the vectors and the keywords share one run of what stands behind the posts."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts

    posts = topic_posts(3, 5).withColumn("content", read.asNondeterministic()("content"))
    _, clusters = C.cluster_posts(posts, k=3, n_init=2)
    assert clusters.agg(F.sum("post_count")).first()[0] == 15 and seen.value == 15


def test_kept_columns_do_not_change_vectors(spark, topic_posts):
    posts = topic_posts(2, 4).withColumn("more", F.lit(1))
    whole, kept = V.embed(posts, size=16), V.embed(posts, size=16, keep=["id"])
    assert whole.columns == ["id", "content", "more", "embedding"] and kept.columns == ["id", "embedding"]
    assert sorted(whole.select("id", "embedding").collect()) == sorted(kept.collect())


def test_many_centres(spark):
    points = spark.range(3).select("id", F.array(F.col("id").cast("double"), F.lit(0.5)).alias("embedding"))
    centers = spark.range(1, 20_001).select(F.col("id").cast("int").alias("cluster_id"),
                                            F.array(F.col("id") * 0.25, F.lit(0.5)).alias("center"))
    found = {r["id"]: (r["cluster_id"], r["distance"]) for r in V.assign_nearest(points, centers).collect()}
    assert found == {0: (1, 0.25), 1: (4, 0.0), 2: (8, 0.0)}


def test_small_clusters_are_merged(spark, topic_posts):
    posts = topic_posts(2, 5).unionByName(topic_posts(3, 5).where("id = 't2-0'"))
    angle = F.when(F.col("id").startswith("t0"), 0.0).when(F.col("id").startswith("t1"), 1.0).otherwise(1.4)
    vectors = posts.select("id", F.array(F.cos(angle), F.sin(angle)).alias("embedding"))
    assignments, clusters = C.cluster_posts(posts, k=3, vectors=vectors, n_init=5, min_size=2)
    labels = {r["id"]: r["cluster_id"] for r in assignments.collect()}
    assert labels["t2-0"] == labels["t1-0"] != labels["t0-0"]
    assert {r["id"]: r["post_count"] for r in clusters.collect()} == {labels["t0-0"]: 5, labels["t1-0"]: 6}


def test_too_few_posts(topic_posts):
    assert C.cluster_posts(topic_posts(1, 3)) == (None, None)


def test_empty_cluster_is_named_by_number(spark):
    posts = spark.createDataFrame([("a", "alpha beta", 1), ("b", "!", 2)], "id string, content string, cluster_id int")
    ids = spark.range(1, 4).select(F.col("id").cast("int").alias("cluster_id"))
    rows = {r["id"]: (r["summary"], r["post_count"], r["keywords"]) for r in K.describe_clusters(posts, ids).collect()}
    assert rows == {1: ("Alpha & Beta", 1, ["alpha", "beta"]), 2: ("Cluster 2", 1, []), 3: ("Cluster 3", 0, [])}


def test_tfidf_by_hand(spark):
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "dd", "ee", "the"]
    rows = [(f"p{i}", " ".join(rng.choices(words, k=8)), i % 3 + 1) for i in range(12)]
    posts = spark.createDataFrame(rows, "id string, content string, cluster_id int")
    counts = {c: Counter(w for _, t, x in rows if x == c for w in t.split() if w != "the") for c in (1, 2, 3)}
    total = sum(counts.values(), Counter())
    vocab = sorted(total, key=lambda w: (-total[w], w))[:4]
    want = {}
    for c in counts:
        raw = {w: counts[c][w] * (math.log(4 / (1 + sum(w in counts[x] for x in counts))) + 1)
               for w in vocab if counts[c][w]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(c, w): v / norm for w, v in raw.items()}
    got = {(r["cluster_id"], r["term"]): r["weight"] for r in
           K.tfidf_weights(posts, stop=["the"], max_features=4).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert len(K.english_stop_words()) > 100


def test_cluster_docs_concatenate_to_the_document(spark):
    rows = [(f"p{i:02}", f"text {i}", 1 if i < 11 else 2) for i in range(15)]
    posts = spark.createDataFrame(rows, "id string, content string, cluster_id int").withColumn(
        "saved_at", F.lit("2024-01-01").cast("timestamp"))
    parts = sorted(K.cluster_docs(posts, part_rows=4).collect())
    for c in (1, 2):
        doc = "".join(r["doc"] for r in parts if r["cluster_id"] == c)
        assert doc == "".join(f" {t}" for _, t, x in rows if x == c)
