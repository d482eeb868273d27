"""From raw pages to post records.

The selectors below are fixed values: they name the classes and attributes of the pages the posts come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import html as H
from postloom.functions import links as L
from postloom.functions import records as R
from postloom.functions.expr import unless
from postloom.functions.text import strip

# Selectors of the result pages.
URN_ATTR = "data-chameleon-result-urn"
POST_ELEMENT = H.by_attr(URN_ATTR, R.ACTIVITY_MARKER)
ACTOR = H.by_class("entity-result__content-actor")
LINK = H.by_tag("a")
LTR_SPAN = H.by_attr("dir", "ltr", "span")
SPAN = H.by_tag("span")

AUTHOR_PATHS = [
    [ACTOR, LINK, LTR_SPAN, SPAN, SPAN],
    [ACTOR, LINK, LTR_SPAN],
    [ACTOR, LINK],
    [H.by_class("feed-shared-actor__name")],
]
PROFILE_PATHS = [
    [ACTOR, H.by_attr("href", "/in/", "a")],
    [H.by_class("feed-shared-actor__container"), LINK],
]
CONTENT_PATHS = [
    [H.by_class("entity-result__content-summary")],
    [H.by_class("feed-shared-text")],
    [H.by_class("update-components-text")],
]
CONTENT_FALLBACK = [[H.by_class("linked-area")]]
ELLIPSES = ("…", "...")
TYPE_PATTERNS = [
    ("article", [H.by_class("entity-result__embedded-object-image--article"), H.by_class("feed-shared-article")]),
    ("video", [H.by_attr("class", "video"), H.by_class("feed-shared-linkedin-video")]),
    ("image", [H.by_class("entity-result__content-image"), H.by_class("feed-shared-image")]),
]
EMBEDDED_TITLE = [H.by_class("entity-result__embedded-object-title")]
EMBEDDED_LINK = [H.by_class("entity-result__embedded-object"),
                 H.by_attr("href", r"linkedin\.com/feed/update", "a")]
SOCIAL_COUNTS = [H.by_class("social-details-social-counts")]

# Elements that may hold a post where pages carry no result marker, most specific first.
ANY_POST_ELEMENTS = [
    H.by_attr("data-urn", R.ACTIVITY_MARKER),
    H.by_attr("data-id", R.ACTIVITY_MARKER),
    H.by_class("feed-shared-update-v2"),
    H.by_class("feed-shared-update"),
    H.by_class("occludable-update"),
    H.by_attr("data-urn", ""),
    H.by_class("artdeco-card"),
    H.by_tag("article"),
    H.by_attr("role", "article"),
]
INFO_AUTHOR = [
    [H.by_class("feed-shared-actor__name")],
    [H.by_class("update-components-actor__name")],
    [H.by_attr("data-control-name", "actor_name")],
]
INFO_CONTENT = [
    [H.by_class("feed-shared-text")],
    [H.by_class("update-components-text")],
    [H.by_class("feed-shared-update-v2__description")],
]

# Selectors of the detail pages.
DETAIL_TEXT = [
    H.by_class("feed-shared-update-v2__description"),
    H.by_class("feed-shared-text"),
    H.by_class("update-components-text"),
    H.by_class("feed-shared-inline-show-more-text"),
    H.by_attr("class", "break-words"),
]
DETAIL_ANCHORS = [
    H.by_attr("href", r"lnkd\.in", "a"),
    H.by_attr("href", "safety/go", "a"),
    H.by_class("feed-shared-article__link"),
    H.by_class("feed-shared-external-video__link"),
]
DETAIL_LINK_AREAS = [H.by_class("feed-shared-text"), H.by_class("update-components-text")]


def clean_author(text: str) -> str:
    return H.stripped(H.replaced(H.stripped(text), R.AUTHOR_TAIL, ""))


def extract_author(element: str, paths: list[list[str]] = AUTHOR_PATHS, default: str = "Unknown") -> Column:
    return F.expr(H.first_text(element, paths, default, clean=clean_author))


def extract_profile(element: str, paths: list[list[str]] = PROFILE_PATHS) -> Column:
    found = [unless(R.clean_profile(F.expr(H.attr(H.select_first(element, *path), "href"))), "") for path in paths]
    return F.coalesce(*found, F.lit(""))


def extract_content(element: str, paths: list[list[str]] = CONTENT_PATHS,
                    fallback: list[list[str]] = CONTENT_FALLBACK) -> Column:
    """First text that is neither empty nor a lone ellipsis, else the text of the fallback area."""
    main = H.unless(H.first_text(element, paths, skip=ELLIPSES), "")
    return F.expr(f"coalesce({main}, {H.first_text(element, fallback)})")


def post_type(html: str, patterns: list[tuple[str, list[str]]] = TYPE_PATTERNS, default: str = "text") -> Column:
    """First type one of whose patterns occurs."""
    def typed(tags: str) -> str:
        cases = [f"when {' or '.join(f'regexp_like({tags}, {H.quoted(p)})' for p in alternatives)} "
                 f"then {H.quoted(name)}" for name, alternatives in patterns]
        return f"case {' '.join(cases)} else {H.quoted(default)} end"

    return F.expr(H.let(H.tags_only(html), typed))


def with_embedded(posts: DataFrame, title: str = "embedded_title", link: str = "embedded_link") -> DataFrame:
    """Append an embedded object to a post: title to the content, link to the links.

    The links of the text are taken before the title is appended.
    """
    content = F.col("content")
    titled = F.when(F.col(title) != "", F.concat(content, F.lit("\n\n["), F.col(title), F.lit("]"))).otherwise(content)
    urls = L.urls_in_text(content)
    links = F.when(F.col(link) != "", F.array_append(urls, F.col(link))).otherwise(urls)
    return posts.withColumns({"content": strip(titled), "links": links}).drop(title, link)


def extract_posts(pages: DataFrame, key: str = "page_id", html: str = "html",
                  engagement: bool = False) -> DataFrame:
    """One post record per post element of every page, with `page_id` and `pos` for the scan order.

    Counts are zero unless `engagement` asks to read them from the element.
    """
    rows = pages.select(F.col(key), F.posexplode(F.expr(H.select_all(html, POST_ELEMENT))).alias("pos", "element"))
    element = "element"
    post_id = R.surrogate_id(F.expr(H.attr(element, URN_ATTR)), F.expr(H.inner_text(element)))
    zero = F.lit(0).cast("bigint")
    counts = (R.parse_engagement(F.expr(H.inner_text(H.select_first(element, *SOCIAL_COUNTS)))) if engagement
              else F.struct(zero.alias("likes"), zero.alias("comments")))
    # The author's selectors narrow down from the same container: one step per projection keeps each
    # expression small and searches every container once.
    steps = rows.withColumn("_actor", F.expr(H.select_first(element, ACTOR)))
    steps = steps.withColumn("_link", F.expr(H.select_first("_actor", LINK)))
    # A link without a name (an image link before it) leads on to the other links and containers.
    elsewhere = H.select_first(element, ACTOR, LINK, LTR_SPAN)
    steps = steps.withColumn("_name", F.expr(f"coalesce({H.select_first('_link', LTR_SPAN)}, {elsewhere})"))
    narrowed = [H.inner_text(H.select_first(H.replaced("_name", "(?s)^<[^>]*>", ""), SPAN, SPAN)),
                H.inner_text("_name"), H.inner_text("_link"), H.inner_text(H.select_first(element, *AUTHOR_PATHS[-1]))]
    author = f"coalesce({', '.join(H.unless(clean_author(text), '') for text in narrowed)}, 'Unknown')"
    fields = steps.select(
        key, "pos",
        post_id.alias("id"),
        F.expr(author).alias("author"),
        extract_profile(element).alias("author_profile"),
        extract_content(element).alias("content"),
        post_type(element).alias("post_type"),
        F.coalesce(F.expr(H.inner_text(H.select_first(element, *EMBEDDED_TITLE))), F.lit("")).alias("embedded_title"),
        F.expr(H.attr(H.select_first(element, *EMBEDDED_LINK), "href")).alias("embedded_link"),
        counts.alias("engagement"),
    )
    return with_embedded(fields).select(
        key, "pos", "id", R.post_url(F.col("id")).alias("url"), "author", "author_profile", "content", "post_type",
        F.current_timestamp().alias("saved_at"), "engagement", "links", F.lit(None).cast("int").alias("cluster_id"))


def _is_post(element: str) -> str:
    marked = " or ".join(f"contains({H.attr(element, name)}, {H.quoted(R.ACTIVITY_MARKER)})"
                         for name in ("data-urn", "data-id"))
    return (f"{marked} or contains({H.attr(element, 'class')}, {H.quoted(R.POST_CLASS)}) "
            f"or length({H.inner_text(element)}) > 50")


def extract_post_info(pages: DataFrame, key: str = "page_id", html: str = "html",
                      patterns: list[str] = ANY_POST_ELEMENTS) -> DataFrame:
    """Short record of every post-like element: id, author, 200-character preview, key of its file.

    The first selector of the list that finds post-like elements on a page is used for that page.
    """
    found = F.expr(H.first_matching(html, patterns, _is_post))
    rows = pages.select(F.col(key), F.posexplode(found).alias("pos", "element"))
    given = F.expr(f"coalesce({H.unless(H.attr('element', 'data-urn'), '')}, {H.attr('element', 'data-id')})")
    info = rows.select(
        key, "pos", R.surrogate_id(given, F.expr(H.inner_text("element"))).alias("id"),
        F.expr(H.first_text("element", INFO_AUTHOR, "unknown")).alias("author"),
        F.substring(F.expr(H.first_text("element", INFO_CONTENT)), 1, 200).alias("content_preview"))
    return info.withColumn("file_key", R.page_file_key(F.col("id")))


def extract_detail(pages: DataFrame, key: str = "id", html: str = "html") -> DataFrame:
    """Full text (the longest candidate) and outbound links of post detail pages, one row per page."""
    def hrefs(elements: str) -> str:
        return H.each(elements, lambda e: H.attr(e, "href"))

    anchors = [H.select_all(html, pattern) for pattern in DETAIL_ANCHORS]
    linked = H.by_attr("href", "", "a")
    areas = [f"flatten({H.each(H.select_all(html, area), lambda e: H.select_all(e, linked))})"
             for area in DETAIL_LINK_AREAS]
    found = F.expr(f"concat({', '.join(hrefs(a) for a in anchors + areas)})")
    return pages.select(key, F.expr(H.longest_text(html, DETAIL_TEXT)).alias("detail_content"),
                        L.outbound_links(found).alias("detail_links"))
