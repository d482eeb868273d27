"""Posts, clusters and batches derived from the test tables, as DataFrames and as SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import checkpointed, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """One post per document; `seq` is the scan order. `heavy` announces much work per row."""
    docs = table(spark, sf_dir, "documents")
    if heavy:
        docs = spread(docs)
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("likes"),
        F.count_if(F.col("event_type") == "view").alias("comments"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("link"))
    labels = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") + 1).alias("cluster_id"))
    seq = F.col("doc_id")
    urn = F.concat(F.lit("urn:li:activity:"), seq.cast("string"))
    kind = F.when(seq % 10 == 0, "article").when(seq % 10 == 1, "video").when(seq % 10 == 2, "image").otherwise("text")
    zero = F.lit(0).cast("bigint")
    return (
        docs.join(events, F.col("user_id") == seq, "left").join(pages, F.col("page_id") == seq, "left")
        .join(labels, F.col("vec_id") == seq, "left")
        .select(
            urn.alias("id"),
            F.concat(F.lit("https://www.linkedin.com/feed/update/"), urn).alias("url"),
            F.col("source").alias("author"),
            F.concat(F.lit("https://www.linkedin.com/in/"), "source", F.lit("?trk="), seq.cast("string"))
            .alias("author_profile"),
            F.col("text").alias("content"), kind.alias("post_type"),
            F.expr("timestampadd(MINUTE, cast(doc_id % 300 as int), timestamp_ntz'2024-01-01 00:00:00')")
            .alias("saved_at"),
            F.struct(F.coalesce("likes", zero).alias("likes"), F.coalesce("comments", zero).alias("comments"))
            .alias("engagement"),
            F.when(F.col("link").isNotNull(), F.array("link")).otherwise(F.array().cast("array<string>"))
            .alias("links"),
            "link", F.col("cluster_id").cast("int").alias("cluster_id"), seq.alias("seq")))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels as clusters, and one empty cluster; written once, like a stored table."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") + 1).cast("int").alias("id"))
    sizes = docs.join(vectors, F.col("vec_id") == F.col("doc_id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("post_count"))
    number = F.col("id").cast("string")
    rows = sizes.select(
        "id", F.array(F.concat(F.lit("kw"), number, F.lit("a")), F.concat(F.lit("kw"), number, F.lit("b")))
        .alias("keywords"), F.concat(F.lit("Topic "), number).alias("summary"), "post_count")
    empty = spark.range(1).select(F.lit(99).alias("id"), F.array(F.lit("kw99a")).alias("keywords"),
                                  F.lit("Topic 99").alias("summary"), F.lit(0).cast("bigint").alias("post_count"))
    return checkpointed(rows.unionByName(empty))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", (F.col("label") + 1).cast("int").alias("cluster_id"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where("seq % 2 = 0").select("id")


def flat_counts(df: DataFrame) -> DataFrame:
    """Posts with `likes` and `comments` as plain columns."""
    return df.withColumns({"likes": F.col("engagement.likes"), "comments": F.col("engagement.comments")})


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates, inserts and repeated ids, in order of arrival `ord`."""
    rows = flat_counts(posts(spark, sf_dir))

    def part(modulus: int, tag: str, version: str, likes: int, shift: int) -> DataFrame:
        return rows.where(F.col("seq") % modulus == 0).select(
            "id", "url", F.concat("author", F.lit(f" ({tag})")).alias("author"),
            F.concat("content", F.lit(f" {version}")).alias("content"), (F.col("likes") + likes).alias("likes"),
            "comments", (F.col("seq") + shift).alias("ord"))

    return part(3, "batch", "v1", 1, 0).unionByName(part(9, "late", "v2", 2, 1_000_000))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that meets every ninth post again later."""
    rows = posts(spark, sf_dir).select("id", "author", F.col("seq").alias("ord"))
    again = rows.where("ord % 9 = 0").withColumn("ord", F.col("ord") + 1_000_000)
    return rows.unionByName(again)


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages: longer, shorter, empty and missing text."""
    rows = posts(spark, sf_dir).where("seq % 5 <> 0")
    text = (F.when(F.col("seq") % 4 == 0, F.concat("content", F.lit(" full text")))
            .when(F.col("seq") % 4 == 1, F.substring("content", 1, 5)).otherwise(""))
    return rows.select("id", text.alias("detail_content"), F.col("links").alias("detail_links"))


def linked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with addresses in its text: that of the page with its number, or a built one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    number = F.col("doc_id").cast("string")
    built = F.concat(F.lit("https://pages.example.net/"), number)
    return docs.join(pages, F.col("page_id") == F.col("doc_id"), "left").withColumn(
        "url", F.coalesce("page_url", built)).select(F.col("doc_id").alias("id"), "url",
        F.concat("text", F.lit(" see "), "url", F.lit(", and (www.site"), number,
                 F.lit(".example.org). x http://a.b")).alias("content"))


def _escaped(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of post elements: every post rendered into a page of its own, beside a page head and foot."""
    rows = flat_counts(posts(spark, sf_dir, heavy=True))
    css = (F.when(F.col("post_type") == "article", "entity-result__embedded-object-image--article")
           .when(F.col("post_type") == "video", "linkedin-video-frame")
           .when(F.col("post_type") == "image", "entity-result__content-image").otherwise("plain"))
    tail = F.when(F.col("seq") % 3 == 0, " • 2nd").when(F.col("seq") % 3 == 1, " • 3rd+ and more").otherwise("")
    embedded = F.when(F.col("seq") % 4 == 0, F.concat(
        F.lit('<div class="entity-result__embedded-object"><div class="entity-result__embedded-object-title">About '),
        "author", F.lit('</div><a href="https://www.linkedin.com/feed/update/'), "id", F.lit('">more</a></div>'))
    ).otherwise("")
    html = F.concat(
        F.lit('<html><body><nav><a href="/x">x</a></nav><ul><li><div class="row" data-chameleon-result-urn="'), "id",
        F.lit('"><div class="entity-result__content-actor"><a href="'), "author_profile",
        F.lit('"><span dir="ltr"><span><span>'), _escaped(F.col("author")), tail,
        F.lit('</span></span></span></a></div><div class="t-14 entity-result__content-summary"><div>'),
        _escaped(F.col("content")), F.lit('</div></div><div class="'), css, F.lit('"></div>'), embedded,
        F.lit('<div class="social-details-social-counts">'), F.format_number("likes", 0), F.lit(" likes &amp; "),
        F.format_number("comments", 0), F.lit(" comments</div></div></li></ul><footer>video</footer></body></html>"))
    return rows.select(F.col("seq").alias("page_id"), html.alias("html"))


def replies(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    """Label replies, one per batch of `size` documents: two overlapping lists and one with unknown ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    urn = F.concat(F.lit("urn:li:activity:"), F.col("doc_id").cast("string"))

    def ids(condition: Column) -> Column:
        return F.collect_list(F.when(condition, urn))

    grouped = docs.groupBy(F.floor(F.col("doc_id") / size).alias("reply_id")).agg(
        ids(F.col("doc_id") % 3 == 0).alias("a"), ids(F.col("doc_id") % 5 == 1).alias("b"))

    def listed(name: str, keywords: Column, post_ids: Column) -> Column:
        return F.struct(F.concat(F.lit(f"{name} "), F.col("reply_id").cast("string")).alias("name"),
                        F.lit("text").alias("description"), keywords.alias("keywords"), post_ids.alias("post_ids"))

    none = F.lit(None).cast("array<string>")
    body = F.to_json(F.array(
        listed("Third", F.array(F.lit("one"), F.lit("two")), F.col("a")),
        listed("Fifth", F.array(F.lit("five")), F.col("b")),
        listed("Ghost", none, F.array(F.lit("urn:li:activity:none"))),
    ))
    fenced = F.when(F.col("reply_id") % 2 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return grouped.select("reply_id", fenced.alias("reply"))


VIEWS_SQL = """with posts_v as (
    select concat('urn:li:activity:', cast(d.doc_id as varchar)) as id,
           concat('https://www.linkedin.com/feed/update/urn:li:activity:', cast(d.doc_id as varchar)) as url,
           d.source as author,
           concat('https://www.linkedin.com/in/', d.source, '?trk=', cast(d.doc_id as varchar)) as author_profile,
           d.text as content,
           case d.doc_id % 10 when 0 then 'article' when 1 then 'video' when 2 then 'image' else 'text' end as post_type,
           cast('2024-01-01 00:00:00' as timestamp) + (d.doc_id % 300) * interval '1' minute as saved_at,
           coalesce(ev.likes, 0) as likes, coalesce(ev.comments, 0) as comments,
           p.url as link, e.label + 1 as cluster_id, d.doc_id as seq
    from documents d
    left join (select user_id, count(case when event_type = 'click' then 1 end) as likes,
                      count(case when event_type = 'view' then 1 end) as comments
               from events group by user_id) ev on ev.user_id = d.doc_id
    left join pages p on p.page_id = d.doc_id
    left join embeddings e on e.vec_id = d.doc_id
), clusters_v as (
    select cast(cluster_id as int) as id, concat('Topic ', cast(cluster_id as varchar)) as summary,
           concat('kw', cast(cluster_id as varchar), 'a, kw', cast(cluster_id as varchar), 'b') as keywords,
           count(*) as post_count
    from posts_v where cluster_id is not null group by cluster_id
    union all select 99, 'Topic 99', 'kw99a', 0
), points_v as (
    select vec_id as id, cast(embedding as double[]) as v, label + 1 as cluster_id from embeddings
), coords_v as (
    select id, cluster_id, unnest(range(len(v))) as pos, unnest(v) as x from points_v
), centers_v as (
    select cluster_id, list(m order by pos) as c
    from (select cluster_id, pos, avg(x) as m from coords_v group by cluster_id, pos) group by cluster_id
), known_v as (
    select id from posts_v where seq % 2 = 0
), batch_v as (
    select id, url, concat(author, ' (batch)') as author, concat(content, ' v1') as content, likes + 1 as likes,
           comments, seq as ord
    from posts_v where seq % 3 = 0
    union all
    select id, url, concat(author, ' (late)') as author, concat(content, ' v2') as content, likes + 2 as likes,
           comments, seq + 1000000 as ord
    from posts_v where seq % 9 = 0
), scan_v as (
    select id, author, seq as ord from posts_v
    union all select id, author, seq + 1000000 from posts_v where seq % 9 = 0
), detail_v as (
    select id, case seq % 4 when 0 then concat(content, ' full text') when 1 then substring(content, 1, 5)
                    else '' end as detail_content, link as detail_link
    from posts_v where seq % 5 <> 0
), text_v as (
    select id, url, concat(text, ' see ', url, ', and (www.site', cast(id as varchar),
                           '.example.org). x http://a.b') as content
    from (select d.doc_id as id, d.text, coalesce(p.url, concat('https://pages.example.net/', cast(d.doc_id as varchar)))
                 as url from documents d left join pages p on p.page_id = d.doc_id)
), tokens_v as (
    select cluster_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}')) as term from posts_v
), terms_v as (
    select cluster_id, term, count(*) as tf from tokens_v where cluster_id is not null group by cluster_id, term
)"""


def sql_strip(expr: str) -> str:
    blank = r"[\t-\r\x1c-\x20\x85\p{Z}]"
    return rf"regexp_replace({expr}, '^{blank}+|{blank}+\z', '', 'g')"


def sql_preview(expr: str, n: int, trim: bool = False) -> str:
    text = f"replace(substring({expr}, 1, {n}), chr(10), ' ')"
    return sql_strip(text) if trim else text


def sql_text(expr: str) -> str:
    """Visible text of HTML."""
    expr = rf"regexp_replace({expr}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g')"
    inline = "a|abbr|b|code|em|font|i|label|mark|s|small|span|strong|sub|sup|time|u"
    expr = rf"regexp_replace({expr}, '(?i)</?(?:{inline})(?:\s[^>]*)?>', '', 'g')"
    expr = f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"
    expr = sql_decoded(expr)
    return sql_strip(rf"regexp_replace({expr}, '[ \t\r\n\f]+', ' ', 'g')")


def sql_decoded(expr: str) -> str:
    """Entities that occur in the test pages, and the basic ones."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


def sql_attr(expr: str, name: str) -> str:
    return sql_decoded(rf"""regexp_extract({expr}, '^<[^>]*?\s{name}="([^"]*)"', 1)""")


def sql_title(expr: str) -> str:
    """Title case of a text."""
    runs = rf"regexp_extract_all({expr}, '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda r: replace(upper(r[1]), 'ẞ', 'Ss') || lower(r[2:])), '')"


def sql_matches(table_name: str, key: str, expr: str, pattern: str) -> str:
    """Rows (key, pos, m) of all matches of a pattern."""
    return (f"select {key}, cast(unnest(range(len(l))) as int) as pos, unnest(l) as m "
            f"from (select {key}, regexp_extract_all({expr}, '{pattern}') as l from {table_name})")
