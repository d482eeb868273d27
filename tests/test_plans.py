"""The physical plans hold what the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postloom import session
from postloom.operators import exports, ingest, keywords, reports
from postloom.sources.tables import load_posts
from postloom.streaming.ingest import read_store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    from postloom.plans import views as V

    path = str(tmp_path_factory.mktemp("store") / "posts")
    V.posts(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def clusters(spark):
    from postloom.plans import views as V

    return V.clusters(spark, SF)


def test_cluster_filter_reaches_the_scan(store):
    text = plan(load_posts(store, 3).select("id", "saved_at"))
    assert "EqualTo(cluster_id,3)" in text
    assert re.search(r"ReadSchema: struct<id:string,saved_at:timestamp_ntz,cluster_id:int>", text)


def test_export_does_not_shuffle_posts(store, clusters):
    text = plan(exports.export_flat(store, clusters))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "ReadSchema" in text


def test_large_cluster_table_is_not_broadcast(spark, store, clusters, monkeypatch):
    monkeypatch.setattr(reports, "broadcast_if_small", lambda df: session.broadcast_if_small(df, max_rows=2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reports.with_clusters(store, clusters))
        assert "SortMergeJoin" in text and "Broadcast" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_check(spark):
    assert session.is_small(spark.range(100), 100) and not session.is_small(spark.range(101), 100)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert not session.is_small(wide, 100, 5000)


def test_spread_leaves_large_inputs_alone(store):
    assert "RoundRobinPartitioning" in plan(session.spread(store))
    assert "RoundRobinPartitioning" not in plan(session.spread(store, max_bytes=10))


def test_first_seen_drops_copies_before_the_shuffle(store):
    text = plan(ingest.first_seen(store.withColumn("ord", F.col("seq"))))
    assert text.index("Exchange") < text.index("row_number(), 1, Partial")


def test_small_batch_spares_the_known_set_a_shuffle(spark, store):
    batch = spark.createDataFrame([("a",), ("b",)], "id string")
    text = plan(ingest.new_only(batch, store, small=True))
    assert "LeftSemi" in text and "ReadSchema: struct<id:string>" in text
    scan_side = text[text.index("LeftSemi"):]
    assert "hashpartitioning" not in scan_side


def test_small_upsert_does_not_shuffle_the_store(spark, store):
    batch = store.limit(3).select("id", "author", "content", F.col("seq").alias("ord"))
    result, _ = ingest.upsert_posts(store.select("id", "author", "content"), batch, ["content"])
    kept = plan(result).split("LeftOuter")[1]
    assert "Exchange hashpartitioning" not in kept.split("LeftAnti")[0]


def test_corpus_is_read_once_for_keywords(store):
    weights = keywords.tfidf_weights(store, n_clusters=10)
    weights.collect()
    final = plan(weights).split("Initial Plan")[0]
    assert final.count("Generate explode") == 1 and "ReusedExchange" in final


def test_stream_store_reads_only_the_ids(spark, tmp_path, store):
    path = str(tmp_path / "s")
    store.select("id", "content").write.parquet(f"{path}/stream=x/batch=0")
    known = read_store(spark, path, store.select("id", "content").schema).where("batch <> 1").select("id")
    assert "ReadSchema: struct<id:string>" in plan(known)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_query_multiplies_tables(spark, name):
    """Only joins with a single row may do without a key."""
    if name in {"auto_k", "cluster_posts", "kmeans_clusters", "stream_ingest", "scatter_points", "embed_text"}:
        pytest.skip("runs models or a stream while it is built")
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    loops = text.count("BroadcastNestedLoopJoin")
    assert loops <= (1 if name in {"status", "ingest_counts", "upsert_counts", "clear_clusters"} else 0)
