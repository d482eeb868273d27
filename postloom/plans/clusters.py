"""Queries for keywords, vectors and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import clustering, keywords, vectors
from postloom.plans import views as V
from postloom.plans.registry import query

STOP = ["the", "and", "to", "of", "de", "la", "le", "und", "der", "die", "que", "et", "in", "on", "en"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

TFIDF_SQL = """
with stats as (
    select term, sum(tf) as total, count(*) as df from terms_v group by term
), vocab as (
    select term, df from stats order by total desc, term limit 1000
), n as (select count(distinct cluster_id) as n from posts_v where cluster_id is not null
), raw as (
    select t.cluster_id, t.term, t.tf, t.tf * (ln((1 + n.n) / (1 + v.df)) + 1) as w
    from terms_v t join vocab v on v.term = t.term cross join n
), weights as (
    select cluster_id, term, tf, w / sqrt(sum(w * w) over (partition by cluster_id)) as weight from raw
), ranked as (
    select *, row_number() over (partition by cluster_id order by round(weight, 9) desc, term) as rank from weights
)
"""


@query("token_counts", "select term, count(*) as n from tokens_v group by term")
def token_counts(spark, sf):
    return keywords.token_counts(V.posts(spark, sf, heavy=True))


@query("term_stats", "select term, cast(sum(tf) as bigint) as total, count(*) as df from terms_v group by term")
def term_stats(spark, sf):
    return keywords.term_stats(keywords.cluster_terms(V.posts(spark, sf, heavy=True))).select("term", "total", "df")


@query("vocabulary", f"""
select term, cast(sum(tf) as bigint) as total, count(*) as df from terms_v where term not in ({STOP_SQL})
group by term order by total desc, term limit 1000""")
def vocabulary(spark, sf):
    stats = keywords.term_stats(keywords.cluster_terms(V.posts(spark, sf, heavy=True), STOP))
    return keywords.vocabulary(stats).select("term", "total", "df")


@query("tfidf_weights", TFIDF_SQL + "select cluster_id, term, tf, round(weight, 6) as weight from weights")
def tfidf_weights(spark, sf):
    return keywords.tfidf_weights(V.posts(spark, sf, heavy=True)).withColumn("weight", F.round("weight", 6))


@query("cluster_keywords", TFIDF_SQL + f"""
select cast(r.cluster_id as int) as cluster_id, string_agg(r.term, ', ' order by r.rank) as keywords,
       {V.sql_title("string_agg(case when r.rank <= 3 then r.term end, ' & ' order by r.rank)")} as title,
       max(s.n) as post_count
from ranked r join (select cluster_id, count(*) as n from posts_v group by cluster_id) s on s.cluster_id = r.cluster_id
where r.rank <= 5 group by r.cluster_id""")
def cluster_keywords(spark, sf):
    found = keywords.describe_clusters(V.posts(spark, sf, heavy=True))
    return found.select(F.col("id").alias("cluster_id"), F.array_join("keywords", ", ").alias("keywords"),
                        F.col("summary").alias("title"), "post_count")


@query("keyword_weights", TFIDF_SQL + """
select cluster_id, cast(rank as int) as rank, term, round(weight, 6) as weight from ranked where rank <= 5""")
def keyword_weights(spark, sf):
    return keywords.top_terms(keywords.tfidf_weights(V.posts(spark, sf, heavy=True))).withColumn("weight", F.round("weight", 6))


@query("cluster_titles", rf"""
select id, {V.sql_title(r"array_to_string(regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}')[1:3], ' & ')")} as title
from posts_v where len(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]{{2,}}')) > 0
union all
select id, 'Cluster 7' from posts_v where len(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]{{2,}}')) = 0""")
def cluster_titles(spark, sf):
    words = keywords.tokens(F.col("content"))
    return V.posts(spark, sf).select("id", keywords.cluster_title(words, F.lit(7)).alias("title"))


@query("cluster_doc_length", """
with ranked as (
    select cluster_id, content,
           row_number() over (partition by cluster_id order by saved_at desc, id) as n
    from posts_v where cluster_id is not null
)
select cluster_id, cast((n - 1) // 20 + 1 as bigint) as part,
       cast(length(string_agg(concat(' ', content), '' order by n)) as bigint) as n_chars,
       md5(string_agg(concat(' ', content), '' order by n)) as digest
from ranked group by cluster_id, (n - 1) // 20""")
def cluster_doc_length(spark, sf):
    docs = keywords.cluster_docs(V.posts(spark, sf), part_rows=20)
    return docs.select("cluster_id", "part", F.length("doc").cast("bigint").alias("n_chars"), F.md5("doc").alias("digest"))


@query("centroids", """
select cluster_id, cast(pos as int) as pos, round(avg(x), 6) as value from coords_v group by cluster_id, pos""")
def centroids(spark, sf):
    return vectors.centroids(V.points(spark, sf)).select(
        "cluster_id", F.posexplode("center").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("cluster_cost", """
select c.cluster_id, count(*) as n, round(sum(list_distance(p.v, c.c) ** 2), 6) as cost
from points_v p join centers_v c on c.cluster_id = p.cluster_id group by c.cluster_id""")
def cluster_cost(spark, sf):
    return vectors.cluster_cost(V.points(spark, sf)).withColumn("cost", F.round("cost", 6))


NEAREST_SQL = """
select id, cast(cluster_id as int) as cluster_id from (
    select p.id, c.cluster_id,
           row_number() over (partition by p.id order by round(list_distance(p.v, c.c), 9), c.cluster_id) as n
    from {points} p cross join {centers} c) where n = 1"""


@query("assign_nearest", NEAREST_SQL.format(points="points_v", centers="centers_v"))
def assign_nearest(spark, sf):
    points = V.points(spark, sf)
    return vectors.assign_nearest(points, vectors.centroids(points)).select("id", "cluster_id")


@query("assign_new", """
with half as (
    select cluster_id, list(m order by pos) as c from (
        select cluster_id, pos, avg(x) as m from coords_v where id % 2 = 0 group by cluster_id, pos)
    group by cluster_id
), fresh as (select * from points_v where id % 2 = 1)
""" + NEAREST_SQL.format(points="fresh", centers="half"))
def assign_new(spark, sf):
    points = V.points(spark, sf).withColumn("cluster_id", F.when(F.col("id") % 2 == 0, F.col("cluster_id")))
    return vectors.assign_new(points).select("id", "cluster_id")


@query("reassign_small", """
with sizes as (select cluster_id, count(*) as n from points_v group by cluster_id),
bound as (select cast(floor(avg(n)) as int) as m from sizes),
pairs as (
    select s.cluster_id as a, l.cluster_id as b,
           row_number() over (partition by s.cluster_id
                              order by round(list_distance(cs.c, cl.c), 9), l.cluster_id) as r
    from sizes s join centers_v cs on cs.cluster_id = s.cluster_id
    cross join sizes l join centers_v cl on cl.cluster_id = l.cluster_id cross join bound
    where s.n < bound.m and l.n >= bound.m
)
select p.id, cast(coalesce(x.b, p.cluster_id) as int) as cluster_id
from points_v p left join pairs x on x.a = p.cluster_id and x.r = 1""")
def reassign_small(spark, sf):
    points = V.points(spark, sf)
    mean_size = points.groupBy("cluster_id").count().agg(F.floor(F.avg("count"))).first()[0]
    return vectors.reassign_small(points, int(mean_size))


SILHOUETTE_SQL = """
with d as (
    select a.id, a.cluster_id as own, b.cluster_id as other, {distance} as d
    from points_v a join points_v b on a.id <> b.id
), means as (
    select id, own, other, avg(d) as m from d group by id, own, other
), scored as (
    select id, max(case when own = other then m end) as a, min(case when own <> other then m end) as b
    from means group by id
)
select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette, count(*) as n from scored"""


@query("silhouette_exact", SILHOUETTE_SQL.format(distance="list_distance(a.v, b.v)"))
def silhouette_exact(spark, sf):
    return vectors.silhouette_exact(V.points(spark, sf)).withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_fast", SILHOUETTE_SQL.format(distance="list_distance(a.v, b.v) ** 2"))
def silhouette_fast(spark, sf):
    points = V.points(spark, sf)
    score = clustering.silhouette_fast(points)
    return points.agg(F.round(F.lit(score), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query("embed_text")
def embed_text(spark, sf):
    return vectors.embed(V.posts(spark, sf, heavy=True).select("id", "content"), size=256).select("id", "embedding")


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return clustering.kmeans(V.points(spark, sf), 10, n_init=2)


@query("auto_k")
def auto_k(spark, sf):
    scores = clustering.sweep_k(V.points(spark, sf))
    chosen = clustering.best_k(scores)
    rows = [(k, float(score), int(k == chosen)) for k, score in scores]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen int")


@query("cluster_posts")
def cluster_posts(spark, sf):
    _, found = clustering.cluster_posts(V.posts(spark, sf), k=8, n_init=2, stop=STOP)
    return found.select("id", F.array_join("keywords", ", ").alias("keywords"), "summary", "post_count")
