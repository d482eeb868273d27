import os

import pytest
from pyspark.sql import functions as F

from postloom.operators import ingest
from postloom.operators.ranking import newest_first_order, positions
from postloom.operators.records import clusters_to_storage, normalize_clusters, normalize_posts, to_storage
from postloom.schemas import PAGES
from postloom.sources import store as S
from postloom.streaming.ingest import ingest_batch, read_store, stream_ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_positions_match_a_window_with_a_hot_group(spark):
    # Group 1 holds most rows and all times are equal.
    rows = spark.range(5000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 10 < 8, 1).otherwise((F.col("id") % 7).cast("int")).alias("g"),
        F.lit("2024-01-01").cast("timestamp").alias("saved_at"))
    got = {r["id"]: (r["g"], r["position"]) for r in
           positions(rows.repartition(8), ["id"], newest_first_order(), group="g").collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        want[r["id"]] = (r["g"], seen[r["g"]])
    assert got == want


def test_positions_over_all_rows_descending(spark):
    rows = spark.range(1000).repartition(7)
    got = {r["id"]: r["position"] for r in positions(rows, ["id"], [(F.col("id"), True)]).collect()}
    assert got == {i: 1000 - i for i in range(1000)}


def test_upsert_column_rule_and_counts(spark):
    schema = "id string, author string, content string, likes int"
    store = frame(spark, [("a", "A", "old", 1), ("b", "B", "keep", 2)], schema)
    batch = frame(spark, [("a", "X", "new", 9, 1), ("c", "C1", "v1", 1, 2), ("c", "C2", "v2", 2, 3),
                          ("a", "Y", None, 10, 4)], schema + ", ord int")
    result, counts = ingest.upsert_posts(store, batch, ["content", "likes"])
    assert {tuple(r) for r in result.collect()} == {("a", "A", None, 10), ("b", "B", "keep", 2), ("c", "C1", "v2", 2)}
    assert tuple(counts.first()) == (1, 3)


def test_upsert_joins_a_large_batch_the_same_way(spark, monkeypatch):
    schema = "id string, author string, content string"
    store = frame(spark, [("a", "A", "old"), ("b", "B", "keep")], schema)
    batch = frame(spark, [("a", "X", "new", 1), ("c", "C", "v", 2)], schema + ", ord int")
    monkeypatch.setattr(ingest, "is_small", lambda df: False)
    result, counts = ingest.upsert_posts(store, batch, ["content"])
    assert {tuple(r) for r in result.collect()} == {("a", "A", "new"), ("b", "B", "keep"), ("c", "C", "v")}
    assert tuple(counts.first()) == (1, 1)


def test_upsert_stamps(spark):
    schema = "id string, content string, created_at timestamp, updated_at timestamp"
    store = frame(spark, [("a", "old"), ("b", "keep")], "id string, content string").withColumns(
        {c: F.to_timestamp(F.lit("2020-01-01")) for c in ("created_at", "updated_at")})
    batch = frame(spark, [("a", "new", 1), ("c", "v", 2)], "id string, content string, ord int")
    now = F.to_timestamp(F.lit("2024-01-01"))
    rows = {r["id"]: (r["created_at"].year, r["updated_at"].year)
            for r in ingest.upsert_posts(store, batch, ["content"], now=now)[0].collect()}
    assert schema and rows == {"a": (2020, 2024), "b": (2020, 2020), "c": (2024, 2024)}


def test_capped_scan_counts(spark):
    scan = frame(spark, [("a", 1), ("k1", 2), ("a", 3), ("b", 4), ("k2", 5), ("c", 6)], "id string, ord int")
    known = frame(spark, [("k1",), ("k2",), ("z",)], "id string")
    assert tuple(ingest.ingest_counts(scan, known).first()) == (3, 3, 0, 2, 6)
    # Stops once two new posts are found, before k2.
    assert tuple(ingest.ingest_counts(scan, known, max_new=2).first()) == (2, 2, 0, 1, 5)


def test_cap(spark, monkeypatch):
    rows = frame(spark, [("c", 3), ("a", 1), ("b", 2)], "id string, ord int")
    assert ingest.cap(rows, None).count() == ingest.cap(rows, 0).count() == 3
    assert {r["id"] for r in ingest.cap(rows, 2).collect()} == {"a", "b"}
    monkeypatch.setattr(ingest, "TOP_N_ROWS", 1)
    assert {r["id"] for r in ingest.cap(rows, 2).collect()} == {"a", "b"}


def test_enrich_rules(spark):
    schema = "id string, url string, content string, links array<string>"
    posts = frame(spark, [("a", "u", "short", ["x"]), ("b", "u", "same", []), ("c", "", "none", []),
                          ("d", "u", "kept", ["y"])], schema)
    detail = frame(spark, [("a", "longer see https://example.org/1", ["y", "x"]), ("b", "text", []),
                           ("c", "much longer text", ["q"])], "id string, detail_content string, detail_links array<string>")
    got = {r["id"]: (r["content"], r["links"]) for r in ingest.enrich_merge(posts, detail).collect()}
    assert got == {"a": ("longer see https://example.org/1", ["x", "y", "https://example.org/1"]),
                   "b": ("same", []), "c": ("none", []), "d": ("kept", ["y"])}


def test_apply_assignments_null_overwrites(spark):
    posts = frame(spark, [("a", 1), ("b", 2), ("c", None)], "id string, cluster_id int")
    given = frame(spark, [("a", None), ("c", 5), ("ghost", 9)], "id string, cluster_id int")
    got = {r["id"]: r["cluster_id"] for r in ingest.apply_assignments(posts, given).collect()}
    assert got == {"a": None, "b": 2, "c": 5}


def test_normalise_round_trip(spark):
    raw = frame(spark, [("a", "u", "A", "p", "c", "article", "2026-01-01T00:00:00+00:00",
                         '{"likes": 3}', '["x", "y"]', "4")],
                "id string, url string, author string, author_profile string, content string, post_type string, "
                "saved_at string, engagement string, links string, cluster_id string")
    post = normalize_posts(raw).first()
    assert post["engagement"].likes == 3 and post["engagement"].comments is None
    assert post["links"] == ["x", "y"] and post["cluster_id"] == 4 and post["saved_at"].year == 2026
    again = normalize_posts(normalize_posts(raw)).first()
    assert again == post
    text = to_storage(normalize_posts(raw)).first()
    assert text["saved_at"].startswith("2026-01-01T00:00:00") and text["links"] == '["x","y"]'
    assert normalize_posts(to_storage(normalize_posts(raw))).first() == post
    bare = normalize_posts(raw.drop("author_profile", "post_type", "cluster_id")).first()
    assert (bare["author_profile"], bare["post_type"], bare["cluster_id"]) == ("", "text", None)


def test_normalise_clusters(spark):
    raw = frame(spark, [(1, '["ai"]', "AI", 2, "2026-01-01T00:00:00+00:00")],
                "id int, keywords string, summary string, post_count int, created_at string")
    row = normalize_clusters(raw).first()
    assert row["keywords"] == ["ai"] and normalize_clusters(clusters_to_storage(normalize_clusters(raw))).first() == row


def test_malformed_json_fails(spark):
    raw = frame(spark, [("a", "u", "A", "c", "2026-01-01", "{bad", "[]")],
                "id string, url string, author string, content string, saved_at string, engagement string, links string")
    with pytest.raises(Exception, match="MALFORMED"):
        normalize_posts(raw).collect()


def test_versions(spark, tmp_path):
    path = str(tmp_path / "posts")
    with pytest.raises(ValueError):
        S.read_version(spark, path)
    assert S.read_version(spark, path, schema=PAGES).count() == 0
    assert S.write_version(spark.range(3), path) == 1
    grown = S.read_version(spark, path).unionByName(spark.range(3, 5))
    assert S.write_version(grown, path) == 2 and S.versions(spark, path) == [1, 2]
    assert S.read_version(spark, path).count() == 5 and S.read_version(spark, path, 1).count() == 3


def test_stream_in_two_batches_equals_one(spark, tmp_path):
    schema = "id string, content string, ord bigint"
    rows = [(f"p{i % 15}", f"text {i}", i) for i in range(20)]
    stored = spark.createDataFrame([], schema).drop("ord").schema

    def run(name, batches):
        source, target = str(tmp_path / name / "in"), str(tmp_path / name / "store")
        for part in batches:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            stream_ingest(spark, stream, target, str(tmp_path / name / "progress"), lambda df: df)
        return {(r["id"], r["content"]) for r in read_store(spark, target, stored).collect()}

    want = {(f"p{i}", f"text {i}") for i in range(15)}
    assert run("one", [rows]) == want
    assert run("two", [rows[:8], rows[8:]]) == want


def test_stream_cap_loses_nothing(spark, tmp_path):
    schema = "id string, content string, ord bigint"
    rows = [(f"p{i:02}", f"text {i}", i) for i in range(20)]
    stored = spark.createDataFrame([], schema).drop("ord").schema

    def run(name, batches):
        source, target = str(tmp_path / name / "in"), str(tmp_path / name / "store")
        for part in batches:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        found = []
        for _ in range(5):  # later runs find no new files
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            stream_ingest(spark, stream, target, str(tmp_path / name / "progress"), lambda df: df, max_new=5)
            found.append(sorted(r["id"] for r in read_store(spark, target, stored).collect()))
        return found

    one = run("one", [rows])
    assert [len(ids) for ids in one] == [5, 10, 15, 20, 20] and one[0] == [f"p{i:02}" for i in range(5)]
    assert [len(ids) for ids in run("two", [rows[:8], rows[8:]])] == [5, 10, 15, 20, 20]


@pytest.mark.parametrize("most", [None, 0])
def test_stream_without_cap_takes_what_waits(spark, tmp_path, most):
    schema = "id string, content string, ord bigint"
    stored = spark.createDataFrame([], schema).drop("ord").schema
    source, target = str(tmp_path / "in"), str(tmp_path / "store")

    def run(rows, max_new):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_ingest(spark, stream, target, str(tmp_path / "progress"), lambda df: df, max_new=max_new)
        return sorted((r["id"], r["content"]) for r in read_store(spark, target, stored).collect())

    first = [(f"p{i:02}", "first") for i in range(12)]
    assert run([(*r, n) for n, r in enumerate(first)], 5) == first[:5]
    # A later post of a waiting id does not replace it.
    assert run([("p11", "second", 0), ("p12", "first", 1)], most) == [*first, ("p12", "first")]


def test_stream_that_starts_anew_adds_nothing_twice(spark, tmp_path):
    schema = "id string, content string, ord bigint"
    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], schema).write.parquet(source)
    stored = spark.createDataFrame([], schema).drop("ord").schema
    for attempt in ("first", "second"):  # the second finds no progress folder
        stream = spark.readStream.schema(schema).parquet(source)
        stream_ingest(spark, stream, target, str(tmp_path / attempt), lambda df: df)
    rows = read_store(spark, target, stored).collect()
    assert sorted(r["id"] for r in rows) == ["a", "b"] and len({r["stream"] for r in rows}) == 1
    names = {name for name in os.listdir(target) if name.startswith("stream=")}
    assert len(names) == 2 and all(len(name) > 30 for name in names)


def test_batch_can_run_again(spark, tmp_path):
    """A batch that failed half-way, here after it wrote other rows, is replaced by its repetition."""
    schema = "id string, content string, ord bigint"
    target = str(tmp_path / "store")

    def rows(*ids):
        return spark.createDataFrame([(i, "x", n) for n, i in enumerate(ids)], schema)

    ingest_batch(rows("a", "b"), target, "s", 0)
    ingest_batch(rows("b", "c"), target, "s", 1)
    ingest_batch(rows("a", "c", "d", "c"), target, "s", 1)
    stored = read_store(spark, target, rows().drop("ord").schema).collect()
    assert sorted((r["id"], r["batch"]) for r in stored) == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]
