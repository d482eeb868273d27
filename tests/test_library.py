"""From result pages to exports over stored tables."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from postloom.library import PostLibrary
from postloom.operators import reports
from postloom.sources.store import versions

TOPICS = ["remote interviews onboarding mentors payroll", "kernel scheduler latency compiler cache"]


def page(ids):
    return "<ul>" + "".join(
        f'<li><div data-chameleon-result-urn="urn:li:activity:{i}"><div class="entity-result__content-actor">'
        f'<a href="https://www.linkedin.com/in/a{i}">Author {i}</a></div>'
        f'<p class="entity-result__content-summary">{TOPICS[i % 2]} note {i}</p></div></li>'
        for i in ids) + "</ul>"


def pages(spark, *groups):
    return spark.createDataFrame([(n, page(g)) for n, g in enumerate(groups)], "page_id bigint, html string")


def test_sync_cluster_export(spark, tmp_path):
    library = PostLibrary(spark, str(tmp_path / "store"))
    assert tuple(library.status().first()) == (0, 0)
    with pytest.raises(reports.NotEnoughPosts):
        library.cluster()
    with pytest.raises(reports.NoClusters):
        library.export("csv", str(tmp_path / "none"))

    first = library.sync(pages(spark, range(0, 6), range(4, 8)), max_new=7)
    assert first == {"synced": 7, "new": 7, "updated": 0, "skipped": 0, "total": 7}
    detail = spark.createDataFrame([
        ("urn:li:activity:9", f'<div class="feed-shared-text">{TOPICS[1]} note 9, see https://example.org/9 now</div>'
                              '<a href="https://lnkd.in/x">x</a>')], "id string, html string")
    second = library.sync(pages(spark, range(0, 12)), details=detail)
    assert second == {"synced": 5, "new": 5, "updated": 0, "skipped": 7, "total": 12}
    assert library.sync(pages(spark, range(0, 12))) == {"synced": 0, "new": 0, "updated": 0, "skipped": 12, "total": 12}
    nine = library.posts().where("id = 'urn:li:activity:9'").first()
    assert nine["links"] == ["https://lnkd.in/x", "https://example.org/9"] and nine["content"].endswith("now")

    before = versions(spark, library.posts_path)
    clusters = library.cluster(k=2, n_init=3)
    assert versions(spark, library.posts_path) == before  # the texts are not rewritten
    assert clusters.count() == 2 and clusters.agg(F.sum("post_count")).first()[0] == 12
    assert library.posts().where("cluster_id is null").count() == 0
    assert library.show().count() == 2
    detail_rows = library.show(1).collect()
    assert [r["number"] for r in detail_rows] == list(range(1, len(detail_rows) + 1))
    assert library.list_posts(1).count() == len(detail_rows) and library.list_clusters().first()["id"] == 1

    for fmt in ("csv", "json", "md"):
        library.export(fmt, str(tmp_path / fmt))
    rows = [r for f in sorted(glob.glob(f"{tmp_path}/csv/part-*")) for r in csv.DictReader(open(f, newline=""))]
    assert len(rows) == 12 and {r["author"] for r in rows} == {f"Author {i}" for i in range(12)}
    objects = [json.loads(x) for f in sorted(glob.glob(f"{tmp_path}/json/part-*")) for x in open(f)]
    assert sorted(o["id"] for o in objects) == [1, 2] and sum(len(o["posts"]) for o in objects) == 12
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/md/part-*")))
    assert text.count("\n## ") == 2 and text.count("\n- **Author") == 12
    with pytest.raises(reports.UnknownCluster):
        library.export("md", str(tmp_path / "x"), cluster_id=9)
    tables = library.chart_tables(library.posts().select("id", F.array(F.length("content").cast("double"), F.lit(1.0))
                                                         .alias("embedding")))
    assert {k: t.count() for k, t in tables.items()} == {"treemap": 15, "nodes": 15, "edges": 14, "scatter": 12}

    reply = json.dumps([{"name": "Evens", "post_ids": [f"urn:li:activity:{i}" for i in range(0, 12, 2)]}])
    labelled = library.apply_labels(spark.createDataFrame([(0, reply)], "reply_id int, reply string"))
    assert {r["summary"]: r["post_count"] for r in labelled.collect()} == {"Evens": 6, "Other": 6}
    library.clear()
    assert tuple(library.status().first()) == (12, 0)


def test_save_updates(spark, tmp_path):
    library = PostLibrary(spark, str(tmp_path))
    row = spark.range(1).select(
        F.lit("p").alias("id"), F.lit("u").alias("url"), F.lit("A").alias("author"), F.lit("").alias("author_profile"),
        F.lit("c").alias("content"), F.lit("text").alias("post_type"), F.current_timestamp().alias("saved_at"),
        F.struct(F.lit(100).cast("bigint").alias("likes"), F.lit(10).cast("bigint").alias("comments")).alias("engagement"),
        F.array(F.lit("l")).alias("links"), F.lit(None).cast("int").alias("cluster_id"), F.lit(1).alias("ord"))
    assert library.save(row) == {"new": 1, "updated": 0}
    louder = row.withColumn("engagement", F.struct(F.lit(200).cast("bigint").alias("likes"),
                                                   F.lit(10).cast("bigint").alias("comments")))
    assert library.save(louder.withColumn("author", F.lit("B"))) == {"new": 0, "updated": 1}
    stored = library.posts().collect()
    assert len(stored) == 1 and stored[0]["engagement"].likes == 200 and stored[0]["author"] == "A"
