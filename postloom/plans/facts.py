"""Queries that state facts about results which have no SQL form themselves, and about record forms and guards."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.operators import charts, clustering, ingest, records, reports, vectors
from postloom.plans import views as V
from postloom.plans.clusters import STOP
from postloom.plans.ingest import COUNTED
from postloom.plans.registry import query
from postloom.sources.tables import read_vectors


@query("kmeans_facts", """
select (select count(*) from points_v) as n_points, round(sum(v * n), 2) as single_cost, true as labels_in_range,
       true as cheaper, true as nearest
from (select var_pop(x) as v, count(*) as n from coords_v group by pos)""")
def kmeans_facts(spark, sf):
    """The model labels every point within 1..10, costs less than one cluster, and few points (2 %) are nearer to
    the mean of another cluster."""
    points = V.points(spark, sf).drop("cluster_id")
    labelled = points.join(clustering.kmeans(points, 10, n_init=2), "id")
    cost = F.sum("cost").alias("cost")
    single = vectors.cluster_cost(points.withColumn("cluster_id", F.lit(1))).agg(cost.alias("single"))
    own = vectors.cluster_cost(labelled).agg(cost.alias("own"))
    moved = vectors.assign_nearest(labelled, vectors.centroids(labelled)).select(
        "id", F.col("cluster_id").alias("best")).join(labelled.select("id", "cluster_id"), "id")
    facts = moved.agg(F.count(F.lit(1)).alias("n_points"), F.min(F.col("cluster_id").between(1, 10)).alias("labels_in_range"),
                      (F.count_if(F.col("best") != F.col("cluster_id")) <= 0.02 * F.count(F.lit(1))).alias("nearest"))
    # All three are single rows.
    rows = facts.unionByName(single, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns]).select(
        "n_points", F.round("single", 2).alias("single_cost"), "labels_in_range",
        (F.col("own") < F.col("single")).alias("cheaper"), "nearest")


@query("auto_k_facts", """
select cast(unnest(range(2, cast(greatest(2, least(floor(sqrt(n)), 20)) as int) + 1)) as int) as k, true as chosen_is_best
from (select count(*) as n from points_v)""")
def auto_k_facts(spark, sf):
    """Every candidate k is scored, and the chosen one is the smallest with the best score."""
    scores = clustering.sweep_k(V.points(spark, sf))
    chosen, best = clustering.best_k(scores), max(score for _, score in scores)
    good = chosen == min(k for k, score in scores if score == best)
    return spark.createDataFrame([(k, good) for k, _ in scores], "k int, chosen_is_best boolean")


@query("cluster_posts_facts", """
select cast(unnest(range(1, 9)) as int) as id, count(*) as assigned from posts_v""")
def cluster_posts_facts(spark, sf):
    """Ids 1..k, and sizes that add up to all posts."""
    assignments, found = clustering.cluster_posts(V.posts(spark, sf), k=8, n_init=2, stop=STOP)
    used = assignments.select(F.col("cluster_id").alias("id")).distinct()
    total = F.sum("post_count").over(Window.partitionBy(F.lit(0)))  # one row per cluster
    return used.join(found.select("id", "post_count"), "id", "left").select("id", total.alias("assigned"))


@query("embed_facts", r"""
select id, 256 as dims, case when len(regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}')) > 0 then 1.0 else 0.0 end
       as norm from posts_v""")
def embed_facts(spark, sf):
    """Vectors have unit length, or are zero where the text has no token."""
    rows = vectors.embed(V.posts(spark, sf, heavy=True).select("id", "content"), size=256)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("id", F.size("embedding").alias("dims"), F.round(F.sqrt(square), 4).alias("norm"))


@query("scatter_facts", f"""
select p.id, concat('<b>', p.author, '</b><br>', {V.sql_preview('p.content', 120, True)}, '...') as text,
       p.cluster_id, concat('Topic ', p.cluster_id) as cluster_name, true as placed
from posts_v p where p.cluster_id is not null""")
def scatter_facts(spark, sf):
    """Every clustered post with its hover text and cluster; those with a vector have a place."""
    rows = V.points(spark, sf).select(F.concat(F.lit("urn:li:activity:"), F.col("id").cast("string")).alias("id"), "embedding")
    found = charts.scatter_points(V.posts(spark, sf), V.clusters(spark, sf), rows)
    placed = (F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).alias("placed")
    return found.select("id", "text", "cluster_id", "cluster_name", placed)


STORED_SQL = """
select id, strftime(saved_at, '%Y-%m-%dT%H:%M:%S+00:00') as saved_at,
       concat('{"likes":', likes, ',"comments":', comments, '}') as engagement,
       case when link is null then '[]' else concat('["', link, '"]') end as links
from posts_v"""


@query("stored_posts", STORED_SQL)
def stored_posts(spark, sf):
    return records.to_storage(V.posts(spark, sf)).select("id", "saved_at", "engagement", "links")


@query("normalized_posts", """
select id, url, author, author_profile, content, post_type, saved_at, likes, comments, coalesce(link, '') as links,
       coalesce(cluster_id, 0) as cluster_id
from posts_v""")
def normalized_posts(spark, sf):
    """The text form of every post, read back."""
    posts = records.normalize_posts(records.to_storage(V.posts(spark, sf)))
    return V.flat_counts(posts).select(
        "id", "url", "author", "author_profile", "content", "post_type", F.col("saved_at").cast("timestamp_ntz")
        .alias("saved_at"), "likes", "comments", F.array_join("links", "|").alias("links"),
        F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


@query("vector_scan", """
select id, len(v) as dims, round(list_sum(v), 4) as total, cluster_id from points_v""")
def vector_scan(spark, sf):
    rows = read_vectors(V.points(spark, sf)).withColumn("v", vector_to_array("features"))
    return rows.select("id", F.size("v").cast("bigint").alias("dims"), F.round(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), "cluster_id")


@query("enough_posts", """
select count(*) as n, count(*) < 6 as refused from posts_v where seq < 5 union all
select count(*), count(*) < 6 from posts_v""")
def enough_posts(spark, sf):
    """The guard lets posts through or refuses them."""
    rows = []
    for posts in (V.posts(spark, sf).where("seq < 5"), V.posts(spark, sf)):
        try:
            rows.append((reports.require_min(posts).count(), False))
        except reports.NotEnoughPosts:
            rows.append((posts.count(), True))
    return spark.createDataFrame(rows, "n bigint, refused boolean")


@query("k_bounds", """
select cluster_id, cast(greatest(2, least(10, n - 1)) as int) as k,
       cast(greatest(2, least(floor(sqrt(n)), 20)) as int) as auto_k
from (select cluster_id, count(*) as n from points_v group by cluster_id)""")
def k_bounds(spark, sf):
    sizes = V.points(spark, sf).groupBy("cluster_id").count().collect()  # ten labels
    return spark.createDataFrame([(r["cluster_id"], clustering.bound_k(10, r["count"]), clustering.auto_k_bound(r["count"]))
                                  for r in sizes], "cluster_id int, k int, auto_k int")


@query("upsert_stamped", """
with folded as (select distinct id from batch_v), store as (select id, saved_at from posts_v where seq % 2 = 0)
select coalesce(s.id, f.id) as id, coalesce(s.saved_at, timestamp '2025-01-01') as created_at,
       case when f.id is null then s.saved_at else timestamp '2025-01-01' end as updated_at
from store s full join folded f on f.id = s.id""")
def upsert_stamped(spark, sf):
    """A new post gets both times, an updated one keeps the first."""
    rows = V.flat_counts(V.posts(spark, sf)).where("seq % 2 = 0")
    store = rows.select("id", "url", "author", "content", "likes", "comments", F.col("saved_at").alias("created_at"),
                        F.col("saved_at").alias("updated_at"))
    now = F.expr("timestamp_ntz'2025-01-01 00:00:00'")
    return ingest.upsert_posts(store, V.batch(spark, sf), COUNTED, now=now)[0].select("id", "created_at", "updated_at")
