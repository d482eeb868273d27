"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
    assert all(row["keywords"].count(", ") == 4 and row["post_count"] > 0 for row in rows)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kmeans_labels_every_point(spark):
    from pyspark.sql import functions as F

    from postloom.operators import vectors
    from postloom.plans import views as V

    labelled = entry.queries()["kmeans_clusters"](spark, SF)
    points = V.points(spark, SF).drop("cluster_id").join(labelled, "id")
    assert points.count() == V.points(spark, SF).count()
    assert set(r[0] for r in labelled.select("cluster_id").distinct().collect()) <= set(range(1, 11))
    # At the optimum each point is nearest to the mean of its own cluster.
    nearest = vectors.assign_nearest(points, vectors.centroids(points)).select("id", F.col("cluster_id").alias("best"))
    moved = points.join(nearest, "id").where("best <> cluster_id").count()
    assert moved <= 0.02 * points.count()


def test_auto_k_in_bounds(spark):
    rows = entry.queries()["auto_k"](spark, SF).collect()
    chosen = [row for row in rows if row["chosen"] == 1]
    assert len(chosen) == 1 and 2 <= chosen[0]["k"] <= 20
    assert chosen[0]["silhouette"] == max(row["silhouette"] for row in rows)


def test_cluster_posts_covers_all(spark):
    rows = entry.queries()["cluster_posts"](spark, SF).collect()
    assert [r["id"] for r in sorted(rows)] == list(range(1, 9))
    assert sum(r["post_count"] for r in rows) == 200


def test_scatter_and_embedding_rows(spark):
    scatter = entry.queries()["scatter_points"](spark, SF)
    assert scatter.count() == 200 and scatter.where("isnan(x) or isnan(y)").count() == 0
    vector = entry.queries()["embed_text"](spark, SF).first()["embedding"]
    assert len(vector) == 256 and abs(sum(v * v for v in vector) - 1) < 1e-5
