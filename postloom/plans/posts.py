"""Queries over post records: scans, fields, reports, exports, chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import links as L
from postloom.functions import records as R
from postloom.functions import text as T
from postloom.operators import charts, exports, labels, reports
from postloom.operators.pages import post_like
from postloom.plans import views as V
from postloom.plans.registry import query
from postloom.sources.tables import load_clusters, load_posts

def _saved():
    return F.col("saved_at").cast("string").alias("saved_at")


@query("posts_scan", """
select id, url, author, author_profile, content, post_type, cast(saved_at as varchar) as saved_at, likes, comments,
       coalesce(link, '') as links, coalesce(cluster_id, 0) as cluster_id from posts_v""")
def posts_scan(spark, sf):
    return load_posts(V.posts(spark, sf)).select(
        "id", "url", "author", "author_profile", "content", "post_type", _saved(),
        R.likes_of(F.col("engagement")).alias("likes"), R.comments_of(F.col("engagement")).alias("comments"),
        F.array_join("links", "|").alias("links"), F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


@query("posts_by_cluster", "select id, author, cast(saved_at as varchar) as saved_at from posts_v where cluster_id = 3")
def posts_by_cluster(spark, sf):
    return load_posts(V.posts(spark, sf), 3).select("id", "author", _saved())


@query("clusters_scan", "select id, summary, keywords, post_count from clusters_v")
def clusters_scan(spark, sf):
    return load_clusters(V.clusters(spark, sf)).select(
        "id", "summary", F.array_join("keywords", ", ").alias("keywords"), "post_count")


@query("post_count", "select count(*) as n from posts_v")
def post_count(spark, sf):
    return reports.post_count(V.posts(spark, sf))


@query("cluster_sizes", "select cluster_id, count(*) as n from posts_v where cluster_id is not null group by cluster_id")
def cluster_sizes(spark, sf):
    return reports.cluster_sizes(V.posts(spark, sf))


@query("status", """
select (select count(*) from posts_v) as post_count, (select count(*) from clusters_v) as cluster_count""")
def status(spark, sf):
    return reports.status(V.posts(spark, sf), V.clusters(spark, sf))


@query("json_field", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return V.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query("post_preview", f"""
select id, {V.sql_preview('content', 60, True)} as p60, {V.sql_preview('content', 80, True)} as p80,
       {V.sql_preview('content', 120)} as p120, {V.sql_preview('content', 150, True)} as p150,
       {V.sql_preview('content', 200)} as p200 from posts_v""")
def post_preview(spark, sf):
    text = F.col("content")
    return V.posts(spark, sf).select(
        "id", T.preview(text, 60, trim=True).alias("p60"), T.preview(text, 80, trim=True).alias("p80"),
        T.preview(text, 120).alias("p120"), T.preview(text, 150, trim=True).alias("p150"),
        T.preview(text, 200).alias("p200"))


@query("keyword_head", r"""
select id, array_to_string(l[1:4], ', ') as first4, array_to_string(l[1:3], ', ') as first3
from (select id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}') as l from posts_v)""")
def keyword_head(spark, sf):
    words = T.tokens(F.col("content"))
    return V.posts(spark, sf).select("id", T.head_items(words, 4, ", ").alias("first4"),
                                     T.head_items(words, 3, ", ").alias("first3"))


@query("post_url", """
select seq, case when seq % 2 = 0 then url else '' end as url from posts_v""")
def post_url(spark, sf):
    post_id = F.when(F.col("seq") % 2 == 0, F.col("id")).otherwise(F.md5("id"))
    return V.posts(spark, sf).select("seq", R.post_url(post_id).alias("url"))


@query("surrogate_id", """
select seq, case when seq % 2 = 0 then id else md5(content) end as id from posts_v""")
def surrogate_id(spark, sf):
    given = F.when(F.col("seq") % 2 == 0, F.col("id")).otherwise("")
    return V.posts(spark, sf).select("seq", R.surrogate_id(given, F.col("content")).alias("id"))


@query("page_file_key", r"""
select page_id, substring(regexp_replace(concat('urn:li:', url), '[^\p{L}\p{N}._-]', '', 'g'), 1, 50) as file_key
from pages""")
def page_file_key(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", R.page_file_key(F.concat(F.lit("urn:li:"), "url")).alias("file_key"))


@query("author_clean", "select seq, author from posts_v")
def author_clean(spark, sf):
    tail = (F.when(F.col("seq") % 5 == 0, " • 2nd").when(F.col("seq") % 5 == 1, "  • 3rd+\nEngineer")
            .when(F.col("seq") % 5 == 2, " • Follower of many").when(F.col("seq") % 5 == 3, "\n").otherwise(""))
    return V.posts(spark, sf).select("seq", R.clean_author(F.concat("author", tail)).alias("author"))


@query("profile_clean", """
select seq, case seq % 3 when 0 then concat('https://www.linkedin.com/in/', author)
                         when 1 then concat('https://example.org/in/', author, '?a=1') else '' end as profile
from posts_v""")
def profile_clean(spark, sf):
    href = (F.when(F.col("seq") % 3 == 0, F.col("author_profile"))
            .when(F.col("seq") % 3 == 1, F.concat(F.lit("https://example.org/in/"), "author", F.lit("?a=1")))
            .otherwise(F.col("url")))
    return V.posts(spark, sf).select("seq", R.clean_profile(href).alias("profile"))


@query("engagement_text", "select id, likes * 37 as likes, comments * 1001 as comments from posts_v")
def engagement_text(spark, sf):
    rows = V.flat_counts(V.posts(spark, sf))
    text = F.concat(F.format_number(F.col("likes") * 37, 0), F.lit(" Reactions - "),
                    F.format_number(F.col("comments") * 1001, 0), F.lit(" comments"))
    return rows.select("id", R.parse_engagement(text).alias("e")).select("id", "e.likes", "e.comments")


@query("engaged_posts", "select id, likes, comments from posts_v where likes > 0 or comments > 0")
def engaged_posts(spark, sf):
    return V.flat_counts(reports.engaged_posts(V.posts(spark, sf))).select("id", "likes", "comments")


def _element_rows(spark, sf):
    return V.posts(spark, sf).select(
        "id", F.when(F.col("seq") % 7 == 0, F.col("id")).otherwise("").alias("element_id"),
        F.when(F.col("seq") % 5 == 0, "feed-shared-text").when(F.col("seq") % 5 == 1, "Search-ITEM").otherwise("x")
        .alias("css_class"),
        F.when(F.col("seq") % 3 == 0, F.col("content")).otherwise(F.col("author")).alias("text"))


@query("postlike_filter", f"""
select id from posts_v where seq % 7 = 0 or seq % 5 = 0
   or (seq % 3 = 0 and length({V.sql_strip('content')}) > 50)""")
def postlike_filter(spark, sf):
    return post_like(_element_rows(spark, sf)).select("id")


@query("postlike_wide", "select id from posts_v where seq % 7 = 0 or seq % 5 <= 1")
def postlike_wide(spark, sf):
    return post_like(_element_rows(spark, sf), wide=True).select("id")


def _sql_cleaned(expr: str) -> str:
    for pattern in (r"https?://[^ \t\r\n]+", r"@[\p{L}\p{N}_]+", r"#[\p{L}\p{N}_]+", r"[ \t\r\n\f]+"):
        expr = f"regexp_replace({expr}, '{pattern}', ' ', 'g')"
    return f"lower({V.sql_strip(expr)})"


@query("clean_text", f"""
select id, {_sql_cleaned("concat('Hi @some_one #Topic ', content, ' END')")} as text from text_v""")
def clean_text(spark, sf):
    text = F.concat(F.lit("Hi @some_one #Topic "), "content", F.lit(" END"))
    return V.linked_text(spark, sf).select("id", T.clean_text(text).alias("text"))


@query("text_urls", r"""
select id, array_to_string([u for u in [regexp_replace(x, '[.,;:!?)]+\z', '') for x in
    regexp_extract_all(content, 'https?://[^\s<>"''\)\],]+|www\.[^\s<>"''\)\],]+')] if length(u) > 10], '|') as urls
from text_v""")
def text_urls(spark, sf):
    return V.linked_text(spark, sf).select("id", F.array_join(L.urls_in_text(F.col("content")), "|").alias("urls"))


@query("redirect_unwrap", "select page_id, url as target from pages")
def redirect_unwrap(spark, sf):
    once = F.url_encode("url")
    href = (F.when(F.col("page_id") % 3 == 0, F.concat(
        F.lit("https://www.linkedin.com/safety/go?x=1&url="), once, F.lit("&trk=a#f")))
        .when(F.col("page_id") % 3 == 1, F.concat(
            F.lit("https://www.linkedin.com/safety/go?url=&url="), F.url_encode(once)))
        .otherwise(F.col("url")))
    return V.table(spark, sf, "pages").select("page_id", L.unwrap_redirect(href).alias("target"))


@query("cluster_summary", """
select id, summary, post_count, keywords, keywords as shown_keywords from clusters_v""")
def cluster_summary(spark, sf):
    return reports.cluster_summary(V.clusters(spark, sf)).withColumn("keywords", F.array_join("keywords", ", "))


@query("cluster_detail", f"""
select c.id as cluster_id, c.summary, c.post_count, c.keywords,
       row_number() over (order by p.saved_at desc, p.id) as number, p.id, p.author,
       {V.sql_preview('p.content', 120)} as preview, p.url, coalesce(p.link, '') as shown_links,
       case when p.likes > 0 or p.comments > 0
            then format('Likes: {{:,}}  Comments: {{:,}}', p.likes, p.comments) else '' end as counts
from posts_v p join clusters_v c on c.id = p.cluster_id where c.id = 1""")
def cluster_detail(spark, sf):
    return reports.cluster_detail(V.posts(spark, sf), V.clusters(spark, sf), 1)


FLAT_SQL = """
select c.id as cluster_id, c.summary as cluster_summary, c.keywords as cluster_keywords, p.id as post_id, p.author,
       p.content, p.post_type, p.likes as engagement_likes, p.comments as engagement_comments, p.url,
       coalesce(p.link, '') as links
from clusters_v c join posts_v p on p.cluster_id = c.id"""


@query("export_flat", FLAT_SQL)
def export_flat(spark, sf):
    return exports.export_flat(V.posts(spark, sf), V.clusters(spark, sf)).drop("saved_at")


@query("export_one_cluster", f"{FLAT_SQL} where c.id = 2")
def export_one_cluster(spark, sf):
    return exports.export_flat(V.posts(spark, sf), V.clusters(spark, sf), 2).drop("saved_at")


@query("export_nested", """
with ranked as (
    select cluster_id, id, (row_number() over (partition by cluster_id order by saved_at desc, id) - 1) // 25 + 1 as part,
           row_number() over (partition by cluster_id order by saved_at desc, id) as n
    from posts_v where cluster_id is not null
), parts as (
    select cluster_id, part, count(*) as n_posts, string_agg(id, '|' order by n) as ids
    from ranked group by cluster_id, part
)
select c.id, c.summary, c.keywords, c.post_count, cast(coalesce(p.part, 1) as bigint) as part,
       coalesce(p.n_posts, 0) as n_posts, coalesce(p.ids, '') as ids
from clusters_v c left join parts p on p.cluster_id = c.id""")
def export_nested(spark, sf):
    nested = exports.export_nested(V.posts(spark, sf), V.clusters(spark, sf), part_rows=25)
    return nested.select("id", "summary", F.array_join("keywords", ", ").alias("keywords"), "post_count", "part",
                         F.size("posts").cast("bigint").alias("n_posts"), F.array_join("posts.id", "|").alias("ids"))


@query("export_markdown", f"""
select 0 as cluster_id, 0 as block, '' as post_id, '# Saved Posts Export' || chr(10) as md
union all
select id, 0, '', concat('## ', summary, ' (', post_count, ' posts)', chr(10), '**Keywords:** ', keywords, chr(10))
from clusters_v
union all
select id, 2, '', '' from clusters_v
union all
select c.id, 1, p.id, concat('- **', p.author, '**: ', {V.sql_preview('p.content', 200)}, chr(10),
       '  - [', p.url, '](', p.url, ')',
       case when p.link is not null then concat(chr(10), '  - External: [link](', p.link, ')') else '' end,
       case when p.likes > 0 or p.comments > 0
            then chr(10) || format('  - Likes: {{:,}} | Comments: {{:,}}', p.likes, p.comments) else '' end)
from clusters_v c join posts_v p on p.cluster_id = c.id""")
def export_markdown(spark, sf):
    return exports.export_markdown(V.posts(spark, sf), V.clusters(spark, sf)).drop("saved_at").fillna(0, ["cluster_id"])


@query("treemap_nodes", f"""
select 'root' as node_id, '' as parent_id, 'All Posts' as label, '' as parent, 0 as value, '' as text, 0 as cluster_id
union all
select concat('cluster_', id), 'root', concat(summary, ' (', post_count, ')'), 'All Posts', 0, keywords, id
from clusters_v
union all
select concat('post_', p.id), concat('cluster_', c.id),
       concat(p.author, ': ', {V.sql_preview('p.content', 80, True)}, '...'),
       concat(c.summary, ' (', c.post_count, ')'), 1,
       concat(p.url, case when p.link is not null then concat('<br>Links: ', p.link) else '' end), c.id
from clusters_v c join posts_v p on p.cluster_id = c.id""")
def treemap_nodes(spark, sf):
    return charts.treemap_nodes(V.posts(spark, sf), V.clusters(spark, sf))


@query("network_nodes", f"""
select 'root' as id, 'Saved Posts' as label, cast(30 as bigint) as size, 'root' as type, '' as keywords, '' as preview,
       '' as url
union all
select concat('cluster_', id), summary, 20 + post_count, 'cluster', keywords, '', '' from clusters_v
union all
select concat('post_', p.id), p.author, 8, 'post', '', {V.sql_preview('p.content', 60, True)}, p.url
from clusters_v c join posts_v p on p.cluster_id = c.id""")
def network_nodes(spark, sf):
    return charts.network_nodes(V.posts(spark, sf), V.clusters(spark, sf))


@query("network_edges", """
select 'root' as source, concat('cluster_', id) as target from clusters_v
union all
select concat('cluster_', c.id), concat('post_', p.id) from clusters_v c join posts_v p on p.cluster_id = c.id""")
def network_edges(spark, sf):
    return charts.network_edges(V.posts(spark, sf), V.clusters(spark, sf))


@query("scatter_points")
def scatter_points(spark, sf):
    vectors = V.points(spark, sf).select(
        F.concat(F.lit("urn:li:activity:"), F.col("id").cast("string")).alias("id"), "embedding")
    return charts.scatter_points(V.posts(spark, sf), V.clusters(spark, sf), vectors)


@query("prompt_lines", f"""
select id, concat('[', id, '] ', author, ': ', {V.sql_preview('content', 150, True)}) as line from posts_v""")
def prompt_lines(spark, sf):
    return labels.prompt_lines(V.posts(spark, sf)).select("id", "line")


@query("prompt_batches", f"""
with numbered as (
    select concat('[', id, '] ', author, ': ', {V.sql_preview('content', 150, True)}) as line,
           row_number() over (order by saved_at desc, id) as n from posts_v
)
select cast((n - 1) // 200 + 1 as bigint) as batch, count(*) as n,
       cast(length(string_agg(line, chr(10) order by n)) as bigint) as chars,
       md5(string_agg(line, chr(10) order by n)) as digest
from numbered group by (n - 1) // 200""".replace("count(*) as n,", "count(*) as n_posts,"))
def prompt_batches(spark, sf):
    return labels.prompt_batches(V.posts(spark, sf)).select(
        "batch", F.col("n").alias("n_posts"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


LISTS_SQL = """
with docs as (select doc_id, doc_id // 100 as r from documents),
lists as (
    select r as reply_id, k as pos, cast(row_number() over (order by r, k) as int) as cluster_id
    from (select distinct r from docs) cross join (select unnest([0, 1, 2]) as k)
), claims as (
    select doc_id, r, 0 as k from docs where doc_id % 3 = 0
    union all select doc_id, r, 1 from docs where doc_id % 5 = 1
), won as (
    select c.doc_id, max(l.cluster_id) as cluster_id from claims c join lists l on l.reply_id = c.r and l.pos = c.k
    group by c.doc_id
), sizes as (
    select r, k, count(*) as n from claims group by r, k
)
"""


def _numbered(spark, sf):
    return labels.number_labels(labels.parse_labels(V.replies(spark, sf)))


@query("labels_parse", LISTS_SQL + """
select l.reply_id, l.pos, concat(['Third ', 'Fifth ', 'Ghost '][l.pos + 1], l.reply_id) as name,
       ['one,two', 'five', ''][l.pos + 1] as keywords,
       case when l.pos = 2 then 1 else coalesce(s.n, 0) end as n_ids, l.cluster_id
from lists l left join sizes s on s.r = l.reply_id and s.k = l.pos""")
def labels_parse(spark, sf):
    return _numbered(spark, sf).select(
        "reply_id", "pos", "name", F.array_join("keywords", ",").alias("keywords"),
        F.size("post_ids").cast("bigint").alias("n_ids"), "cluster_id")


@query("label_assign", LISTS_SQL + """
select p.id, cast(coalesce(w.cluster_id, (select count(*) from lists) + 1) as int) as cluster_id
from posts_v p left join won w on w.doc_id = p.seq""")
def label_assign(spark, sf):
    return labels.labels_to_assignments(V.posts(spark, sf), _numbered(spark, sf))


@query("label_clusters", LISTS_SQL + """
select l.cluster_id as id, concat(['Third ', 'Fifth ', 'Ghost '][l.pos + 1], l.reply_id) as summary,
       ['one,two', 'five', ''][l.pos + 1] as keywords,
       case when l.pos = 2 then 1 else coalesce(s.n, 0) end as post_count
from lists l left join sizes s on s.r = l.reply_id and s.k = l.pos
union all
select cast((select count(*) from lists) + 1 as int), 'Other', 'unassigned', n
from (select count(*) as n from documents where doc_id not in (select doc_id from won)) where n > 0""")
def label_clusters(spark, sf):
    return labels.labels_to_clusters(V.posts(spark, sf), _numbered(spark, sf)).select(
        "id", "summary", F.array_join("keywords", ",").alias("keywords"), "post_count")
