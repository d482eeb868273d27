"""Queries over raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import html as H
from postloom.functions import links as L
from postloom.operators import extract, ingest, pages
from postloom.plans import views as V
from postloom.plans.registry import query
from postloom.session import spread
from postloom.sources.tables import read_pages

A_PATTERN = r"(?s)<a\s[^>]*>.*?</a>"
ANCHORS_SQL = f"""
select page_id, pos, {V.sql_attr('m', 'href')} as href, {V.sql_text('m')} as text
from ({V.sql_matches('pages', 'page_id', 'html', A_PATTERN)})"""


def _pages(spark, sf):
    return spread(read_pages(spark, f"{sf}/pages.parquet"))


def _inner(tag: str, html: str = "html") -> str:
    return V.sql_text(f"regexp_extract({html}, '(?s)<{tag}>(.*?)</{tag}>', 1)")


@query("pages_elements", V.sql_matches("pages", "page_id", "html", r"<p(?:\s[^>]*)?>").replace("as m ", "as tag "))
def pages_elements(spark, sf):
    return pages.elements(_pages(spark, sf), H.by_tag("p"))


@query("pages_anchors", ANCHORS_SQL)
def pages_anchors(spark, sf):
    return pages.anchors(_pages(spark, sf))


@query("pages_frames", f"""
select page_id, pos, 'No src' as src, 'No name' as name, 'No id' as id,
       coalesce(nullif({V.sql_attr('m', 'class')}, ''), 'No classes') as classes
from ({V.sql_matches('pages', 'page_id', 'html', r'<div(?:[ ][^>]*)?>')})""")
def pages_frames(spark, sf):
    # The test pages have no frames; their div elements stand in for them.
    return pages.frames(_pages(spark, sf), tag="div")


@query("pages_text", f"""
select page_id, cast(length(t) as bigint) as n_chars, md5(t) as digest
from (select page_id, {V.sql_text('html')} as t from pages)""")
def pages_text(spark, sf):
    rows = _pages(spark, sf).select("page_id", F.expr(H.inner_text("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("pages_author", f"""
select page_id, coalesce(nullif({_inner('h2')}, ''), nullif({_inner('h1')}, ''), nullif({_inner('title')}, ''),
       'Unknown') as author from pages""")
def pages_author(spark, sf):
    paths = [[H.by_class("actor")], [H.by_tag("h2")], [H.by_tag("h1")], [H.by_tag("title")]]
    return _pages(spark, sf).select("page_id", extract.extract_author("html", paths).alias("author"))


@query("pages_content", f"""
select page_id, md5(coalesce(nullif({_inner('h3')}, ''), nullif({_inner('nav')}, ''), {_inner('footer')})) as digest
from pages""")
def pages_content(spark, sf):
    content = extract.extract_content("html", [[H.by_tag("h3")], [H.by_tag("nav")]], [[H.by_tag("footer")]])
    return _pages(spark, sf).select("page_id", F.md5(content).alias("digest"))


@query("pages_type", r"""
select page_id, case when html like '%class="ad"%' then 'article' when html like '%<h1>%' then 'video'
                     else 'text' end as post_type from pages""")
def pages_type(spark, sf):
    patterns = [("article", [H.by_class("ad"), H.by_class("feed-shared-article")]), ("video", [H.by_tag("h1")])]
    return _pages(spark, sf).select("page_id", extract.post_type("html", patterns).alias("post_type"))


@query("pages_longest_text", f"""
with found as (
    select page_id, 0 as k, pos, {V.sql_text('m')} as t
    from ({V.sql_matches('pages', 'page_id', 'html', A_PATTERN)})
    union all
    select page_id, 1, pos, {V.sql_text('m')}
    from ({V.sql_matches('pages', 'page_id', 'html', '(?s)<h1>.*?</h1>')})
), best as (
    select page_id, t, row_number() over (partition by page_id order by length(t) desc, k, pos) as n from found
)
select p.page_id, coalesce(b.t, '') as text from pages p left join best b on b.page_id = p.page_id and b.n = 1""")
def pages_longest_text(spark, sf):
    text = F.expr(H.longest_text("html", [H.by_tag("a"), H.by_tag("h1")]))
    return _pages(spark, sf).select("page_id", text.alias("text"))


def _hrefs(spark, sf):
    rows = pages.anchors(_pages(spark, sf))
    href = (F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("#"), "href"))
            .when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://x.example/in"), "href"))
            .when((F.col("page_id") % 4 == 3) & (F.col("pos") % 2 == 0), "").otherwise(F.col("href")))
    return rows.withColumn("href", href)


@query("page_links_kept", f"""
select page_id, pos, href from ({ANCHORS_SQL})
where page_id % 4 = 0 or (page_id % 4 = 3 and pos % 2 = 1)""")
def page_links_kept(spark, sf):
    return _hrefs(spark, sf).where(L.keep_link(F.col("href"))).select("page_id", "pos", "href")


@query("links_matching", f"""
select page_id, pos, href, text from ({ANCHORS_SQL})
where lower(href) like '%un%' or lower(href) like '%the%' or lower(text) like '%un%' or lower(text) like '%the%'""")
def links_matching(spark, sf):
    return pages.links_matching(pages.anchors(_pages(spark, sf)), ["un", "The"])


@query("short_text_matches", f"""
select page_id, pos, text from ({ANCHORS_SQL}) where lower(text) like '%en%' and length(text) < 6""")
def short_text_matches(spark, sf):
    return pages.short_matches(pages.anchors(_pages(spark, sf)), "en", 6).select("page_id", "pos", "text")


def _count(needle: str) -> str:
    return f"cast((length(html) - length(replace(html, '{needle}', ''))) / {len(needle)} as bigint)"


@query("page_stats", f"""
select page_id, cast(length(html) as bigint) as n_chars, {_count('<div')} as n_div, {_count('<a ')} as n_anchor,
       {_count('<article')} as n_article, cast(contains(html, 'data-urn') as int) as has_data_urn,
       cast(contains(html, 'urn:li:activity') as int) as has_activity,
       cast(contains(html, 'feed-shared') as int) as has_feed_shared,
       cast(contains(lower(html), 'saved posts') as int) as has_saved_posts,
       cast(contains(lower(html), 'saved posts') and contains(html, '10+') as int) as has_saved_counter
from pages""")
def page_stats(spark, sf):
    return pages.page_stats(_pages(spark, sf))


def _indicators_sql(html: str) -> str:
    parts = ", ".join(f"case when contains(lower({html}), '{p}') then '{p}: ' || ((length({html}) - length(replace("
                      f"lower({html}), '{p}', ''))) // {len(p)}) end" for p in pages.POST_INDICATORS)
    return f"concat_ws('|', {parts})"


@query("page_records", f"""
select page_id, url, {_inner('title')} as title, cast(length(html) as bigint) as n_chars,
       {_indicators_sql('html')} as indicators
from pages""")
def page_records(spark, sf):
    return pages.page_records(_pages(spark, sf)).withColumn("indicators", F.array_join("indicators", "|"))


@query("page_frame_records", f"""
with first as (select url, arg_min(html, page_id) as html from pages group by url),
inside as (select page_id, '<title>Frame ' || page_id || '</title> Saved posts, post' as html from pages)
select p.page_id, cast(0 as int) as frame, p.url, {_inner('title', 'f.html')} as title,
       cast(length(f.html) as bigint) as n_chars, {_indicators_sql('f.html')} as indicators
from pages p join first f on f.url = p.url
union all
select page_id, 1, 'about:srcdoc', 'Frame ' || page_id, length(html), {_indicators_sql('html')} from inside""")
def page_frame_records(spark, sf):
    """The test pages have no frames: each gets one with its own address and one with a source of its own."""
    rows = _pages(spark, sf)
    framed = F.concat("html", F.lit('<iframe class="a" src="'), "url", F.lit('"></iframe><iframe srcdoc="<title>Frame '),
                      F.col("page_id").cast("string"), F.lit('</title> Saved posts, post"></iframe>'))
    found = pages.frame_records(rows.withColumn("html", framed), rows)
    return found.withColumn("indicators", F.array_join("indicators", "|"))


PHRASES = ["The", "article", "post", "saved posts", "<p>", "de"]


def _phrases_sql() -> str:
    listed = ", ".join(f"'{p}'" for p in PHRASES)
    return f"""
select page_id, phrase, cast((length(t) - length(replace(t, lower(phrase), ''))) / length(phrase) as bigint) as n
from (select page_id, lower(html) as t from pages) cross join (select unnest([{listed}]) as phrase)"""


@query("page_phrase_counts", _phrases_sql())
def page_phrase_counts(spark, sf):
    return pages.phrase_counts(_pages(spark, sf), PHRASES)


@query("page_indicators", f"select * from ({_phrases_sql()}) where n > 0")
def page_indicators(spark, sf):
    return pages.phrase_counts(_pages(spark, sf), PHRASES, positive_only=True)


PROFILED = {"p": H.by_tag("p"), "a": H.by_tag("a"), "nav": H.by_tag("nav"), "iframe": H.by_tag("iframe")}


@query("page_element_profile", " union all ".join(f"""
select page_id, '{name}' as selector, cast(len(l) as bigint) as n,
       case when len(l) < 10 then array_to_string(l[1:3], ' ') else '' end as examples
from (select page_id, regexp_extract_all(html, '{pattern}') as l from pages)""" for name, pattern in PROFILED.items()))
def page_element_profile(spark, sf):
    return pages.element_profile(_pages(spark, sf), PROFILED).withColumn("examples", F.array_join("examples", " "))


@query("page_block_links", rf"""
select page_id, pos, substring({V.sql_text('m')}, 1, 200) as preview, cast(len(links) as bigint) as n_links,
       array_to_string([concat({V.sql_text('x')}, '=', {V.sql_attr('x', 'href')}) for x in links[1:3]], '|') as first_links
from (select *, regexp_extract_all(m, '{A_PATTERN}') as links
      from ({V.sql_matches('pages', 'page_id', 'html', '(?s)<nav>.*?</nav>')}))""")
def page_block_links(spark, sf):
    shown = F.transform("first_links", lambda a: F.concat(a["text"], F.lit("="), a["href"]))
    return pages.block_links(_pages(spark, sf), H.by_tag("nav")).withColumn("first_links", F.array_join(shown, "|"))


@query("embedded_append", f"""
select id, {V.sql_strip("case when id % 3 = 0 then concat(content, chr(10), chr(10), '[Topic ', id, ']') else content end")} as content,
       concat(url, '|www.site', id, '.example.org', case when id % 2 = 0 then concat('|', url, '#e') else '' end) as links
from text_v""")
def embedded_append(spark, sf):
    title = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Topic "), F.col("id").cast("string"))).otherwise("")
    link = F.when(F.col("id") % 2 == 0, F.concat("url", F.lit("#e"))).otherwise("")
    rows = V.linked_text(spark, sf).withColumns({"embedded_title": title, "embedded_link": link})
    return extract.with_embedded(rows).select("id", "content", F.array_join("links", "|").alias("links"))


@query("extract_posts", rf"""
select id, url, author,
       concat('https://www.linkedin.com/in/', author) as author_profile,
       {V.sql_strip("concat(t, case when seq % 4 = 0 then concat(chr(10), chr(10), '[About ', author, ']') else '' end)")}
           as content,
       post_type, likes, comments,
       case when seq % 4 = 0 then url else '' end as links
from (select *, {V.sql_strip(r"regexp_replace(content, '[ \t\r\n\f]+', ' ', 'g')")} as t from posts_v)""")
def extract_posts(spark, sf):
    posts = extract.extract_posts(V.cards(spark, sf), engagement=True)
    return V.flat_counts(posts).select(
        "id", "url", "author", "author_profile", "content", "post_type", "likes", "comments",
        F.array_join("links", "|").alias("links"))


@query("post_info", f"""
select page_id, pos, md5(t) as id, 'unknown' as author, '' as content_preview,
       md5(t) as file_key
from (select page_id, cast(row_number() over (partition by page_id order by pos) - 1 as int) as pos, t
      from (select page_id, pos, {V.sql_text('m')} as t
            from ({V.sql_matches('pages', 'page_id', 'html', '(?s)<article>.*?</article>')})) where length(t) > 50)""")
def post_info(spark, sf):
    return extract.extract_post_info(_pages(spark, sf))


@query("merge_links", """
select id, concat(url, '|www.site', id, '.example.org') as links from text_v""")
def merge_links(spark, sf):
    rows = V.linked_text(spark, sf)
    merged = L.merge_links(F.array("url"), F.array("url", "url"), L.urls_in_text(F.col("content")))
    return rows.select("id", F.array_join(merged, "|").alias("links"))


@query("enrich_merge", """
select p.id, case when length(d.detail_content) > length(p.content) then d.detail_content else p.content end as content,
       coalesce(p.link, '') as links
from posts_v p left join detail_v d on d.id = p.id""")
def enrich_merge(spark, sf):
    merged = ingest.enrich_merge(V.posts(spark, sf), V.detail(spark, sf))
    return merged.select("id", "content", F.array_join("links", "|").alias("links"))
