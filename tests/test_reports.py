import csv
import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.operators import charts, exports, labels, reports
from postloom.schemas import CLUSTERS, POSTS
from postloom.sources import store as S
from postloom.sources.tables import load_clusters, load_posts, read_pages

DAY = datetime(2026, 1, 1)


@pytest.fixture
def posts(spark):
    rows = [
        ("p1", "https://x/1", "Ann", "", 'He said "hi",\nthen left ', "text", DAY, (1234, 5), ["https://a", "https://b",
         "https://c", "https://d"], 1),
        ("p2", "https://x/2", "Bob", "", "", "article", DAY, (0, 0), [], 1),
        ("p3", "https://x/3", "Cem", "", "c" * 250, "text", DAY, (None, None), [], 2),
        ("p4", "https://x/4", "Dan", "", "unclustered", "text", DAY, None, None, None),
    ]
    return spark.createDataFrame(rows, POSTS)


@pytest.fixture
def clusters(spark):
    rows = [(1, ["ai", "ml"], "AI & ML", 2, DAY), (2, ["x"], "AI & ML", 1, DAY), (3, [], "Empty", 0, DAY)]
    return spark.createDataFrame(rows, CLUSTERS)


def lines(path):
    text = "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{path}/part-*")))
    return text


def test_loads(posts, clusters):
    assert [r["id"] for r in load_posts(posts).collect()] == ["p1", "p2", "p3", "p4"]
    assert [r["id"] for r in load_posts(posts, 1).collect()] == ["p1", "p2"]
    assert [r["id"] for r in load_clusters(clusters).collect()] == [1, 2, 3]


def test_csv_parses_back(posts, clusters, tmp_path):
    path = str(tmp_path / "flat")
    exports.write_flat(exports.export_flat(posts, clusters), path)
    files = sorted(glob.glob(f"{path}/part-*"))
    rows = [row for f in files for row in csv.DictReader(open(f, encoding="utf-8", newline=""))]
    assert [r["post_id"] for r in rows] == ["p1", "p2", "p3"] and len(rows[0]) == 11
    assert rows[0]["content"] == 'He said "hi",\nthen left ' and rows[0]["cluster_keywords"] == "ai, ml"
    assert rows[0]["links"] == "https://a|https://b|https://c|https://d"
    assert rows[1]["content"] == "" and rows[2]["engagement_likes"] == "0"


def test_nested_keeps_empty_clusters_and_splits_large_ones(posts, clusters, tmp_path):
    path = str(tmp_path / "nested")
    exports.write_nested(exports.export_nested(posts, clusters, part_rows=1), path)
    rows = [json.loads(line) for line in lines(path).splitlines()]
    assert [(r["id"], r["part"], [p["id"] for p in r["posts"]]) for r in rows] == [
        (1, 1, ["p1"]), (1, 2, ["p2"]), (2, 1, ["p3"]), (3, 1, [])]
    assert rows[0]["posts"][0].keys() == {"id", "author", "content", "url", "post_type", "engagement", "links"}
    assert rows[0]["summary"] == "AI & ML" and rows[0]["posts"][0]["engagement"] == {"likes": 1234, "comments": 5}


def test_markdown_document(posts, clusters, tmp_path):
    path = str(tmp_path / "md")
    exports.write_markdown(exports.export_markdown(posts, clusters), path)
    assert lines(path) == (
        "# Saved Posts Export\n\n"
        "## AI & ML (2 posts)\n**Keywords:** ai, ml\n\n"
        '- **Ann**: He said "hi", then left \n  - [https://x/1](https://x/1)\n'
        "  - External: [link](https://a), [link](https://b), [link](https://c)\n  - Likes: 1,234 | Comments: 5\n"
        "- **Bob**: \n  - [https://x/2](https://x/2)\n\n"
        f"## AI & ML (1 posts)\n**Keywords:** x\n\n- **Cem**: {'c' * 200}\n  - [https://x/3](https://x/3)\n\n"
        "## Empty (0 posts)\n**Keywords:** \n\n\n")


def test_one_cluster_and_errors(posts, clusters):
    assert exports.export_flat(posts, clusters, 2).count() == 1
    assert exports.export_nested(posts, clusters, 3).first()["posts"] == []
    with pytest.raises(reports.UnknownCluster):
        exports.export_flat(posts, clusters, 77)
    with pytest.raises(reports.NoClusters):
        exports.export_markdown(posts, clusters.limit(0))
    with pytest.raises(reports.NotEnoughPosts, match="have 4"):
        reports.require_min(posts)
    assert reports.require_min(posts, 4) is posts


def test_detail_and_status(posts, clusters):
    rows = reports.cluster_detail(posts, clusters, 1).orderBy("number").collect()
    assert [(r["number"], r["id"], r["counts"]) for r in rows] == [
        (1, "p1", "Likes: 1,234  Comments: 5"), (2, "p2", "")]
    assert rows[0]["shown_links"] == "https://a, https://b, https://c"
    assert reports.cluster_detail(posts, clusters, 77).count() == 0
    assert tuple(reports.status(posts, clusters).first()) == (4, 3)
    assert {r["id"] for r in reports.engaged_posts(posts).collect()} == {"p1"}


def test_charts(posts, clusters):
    nodes = charts.treemap_nodes(posts, clusters).collect()
    assert len(nodes) == 7 and len({r["node_id"] for r in nodes}) == 7
    post = next(r for r in nodes if r["node_id"] == "post_p1")
    assert post["label"] == 'Ann: He said "hi", then left...' and post["parent_id"] == "cluster_1"
    assert post["text"] == "https://x/1<br>Links: https://a, https://b"
    assert charts.network_nodes(posts, clusters).where("id = 'cluster_1'").first()["size"] == 22
    assert charts.network_edges(posts, clusters).count() == 6
    vectors = posts.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert charts.scatter_points(posts, clusters, vectors).count() == 0  # only three clustered posts


def test_prompt_batches(posts):
    texts = {r["batch"]: r["text"] for r in labels.prompt_batches(posts, 3).collect()}
    assert texts[2] == "[p4] Dan: unclustered" and texts[1].startswith('[p1] Ann: He said "hi", then left\n[p2] Bob: \n')


def replies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "reply_id int, reply string")


LISTS = json.dumps([
    {"name": "One", "description": "d", "keywords": ["k"], "post_ids": ["p1", "p2"]},
    {"name": "Two", "post_ids": ["p2", "ghost"]},
])


@pytest.mark.parametrize("text", [LISTS, f"Sure:\n```json\n{LISTS}\n``` done"])
def test_labels(spark, posts, text):
    numbered = labels.number_labels(labels.parse_labels(replies(spark, text)))
    got = {r["id"]: r["cluster_id"] for r in labels.labels_to_assignments(posts, numbered).collect()}
    assert got == {"p1": 1, "p2": 2, "p3": 3, "p4": 3}  # the last list wins; the rest goes to the catch-all
    rows = sorted(labels.labels_to_clusters(posts, numbered).select("id", "keywords", "summary", "post_count").collect())
    assert [tuple(r) for r in rows] == [(1, ["k"], "One", 2), (2, [], "Two", 2), (3, ["unassigned"], "Other", 2)]


def test_labels_without_rest(spark, posts):
    text = json.dumps([{"name": "All", "post_ids": ["p1", "p2", "p3", "p4"]}])
    numbered = labels.number_labels(labels.parse_labels(replies(spark, text)))
    assert labels.labels_to_clusters(posts, numbered).count() == 1


def test_label_reply_that_is_not_json(spark):
    with pytest.raises(Exception, match="MALFORMED"):
        labels.parse_labels(replies(spark, "sorry, no")).collect()


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one</p>\n<p>two</p>")
    row = read_pages(spark, str(tmp_path), fmt="html").first()
    assert row["html"] == "<p>one</p>\n<p>two</p>" and row["url"].endswith("a.html")


def test_page_files(spark, tmp_path):
    rows = spark.createDataFrame([("b",), ("a",)], "file_key string")
    S.write_page_files(rows, str(tmp_path / "files"))
    assert [json.loads(x)["file_key"] for x in lines(str(tmp_path / "files")).splitlines()] == ["a", "b"]


def test_malformed_reply_is_set_aside(spark):
    rows = spark.createDataFrame([(0, '[{"name": "A", "post_ids": ["x"]}]'), (1, "sorry, no"), (2, None), (3, "[]"),
                                  (4, '[{"name": "B"}, {"name": "C"}]')], "reply_id int, reply string")
    numbered = labels.number_labels(labels.parse_labels(rows, strict=False)).collect()
    assert {r["name"]: r["cluster_id"] for r in numbered} == {"A": 1, "B": 2, "C": 3}
    assert {r["reply_id"] for r in labels.malformed_replies(rows).collect()} == {1, 2}
