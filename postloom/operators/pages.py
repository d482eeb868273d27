"""Operators over a table of raw pages: elements, links, text and page profiles.

Everything is computed inside the row that holds the page, so no operator here shuffles; a page that
yields many elements only makes its own task longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import html as H
from postloom.functions import text as T
from postloom.functions.records import is_post
from postloom.session import broadcast_if_small

# Tags counted by the page statistics, and markers whose presence is flagged.
STAT_TAGS = {"n_div": "<div", "n_anchor": "<a ", "n_article": "<article"}
STAT_MARKERS = {"has_data_urn": "data-urn", "has_activity": "urn:li:activity", "has_feed_shared": "feed-shared"}
# Phrases searched by default.
KEY_PHRASES = ["saved posts", "10+", "data-urn", "urn:li:activity", "feed-shared-update", "artdeco-card", "post",
               "update"]
POST_INDICATORS = ["saved posts", "data-urn", "urn:li:activity", "feed-shared", "post"]


def elements(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html",
             whole: bool = False) -> DataFrame:
    """One row per element whose start tag matches, with its 0-based position.

    `tag` is the start tag; with `whole` the outer HTML comes along as `element`.
    """
    if whole:
        found = pages.select(key, F.posexplode(F.expr(H.select_all(html, pattern))).alias("pos", "element"))
        return found.select(key, "pos", F.expr(H.start_tag("element")).alias("tag"), "element")
    matches = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    return pages.select(key, F.posexplode(matches).alias("pos", "tag"))


def anchors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Links of each page with position, href and text."""
    matches = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<a\s[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(key, F.posexplode(matches).alias("pos", "element"))
    return rows.select(key, "pos", F.expr(H.attr("element", "href")).alias("href"),
                       F.expr(H.inner_text("element")).alias("text"))


def frames(pages: DataFrame, key: str = "page_id", html: str = "html", tag: str = "iframe") -> DataFrame:
    """Attributes of embedded frames, with the placeholder text where one is missing."""
    rows = elements(pages, H.by_tag(tag), key, html)
    return rows.select(key, "pos", F.expr(H.attr("tag", "src", "No src")).alias("src"),
                       F.expr(H.attr("tag", "name", "No name")).alias("name"),
                       F.expr(H.attr("tag", "id", "No id")).alias("id"),
                       F.expr(H.attr("tag", "class", "No classes")).alias("classes"))


# A start tag whose quoted values may hold a `>`, and an attribute of it behind any others.
FRAME = r"""<(?i:iframe)(?:\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)?>"""
_BEFORE = r"""(?s)^<\w+(?:\s+[^\s=>"']+(?:=(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?)*?\s+"""


def _frame_attr(tag: str, name: str) -> str:
    double, single = (H.quoted(rf"{_BEFORE}(?i:{name})={q}([^{q}]*){q}") for q in ('"', "'"))
    found = f"concat(regexp_extract({tag}, {double}, 1), regexp_extract({tag}, {single}, 1))"
    return H.unless(H.decode_entities(found), "")


def resolved(link: str, base: str) -> str:
    """The address of a link on the page at `base` (both SQL text), as a browser would open it."""
    origin = f"regexp_extract({base}, {H.quoted(r'^[a-zA-Z][\w+.-]*://[^/?#]*')}, 0)"
    folder = f"regexp_extract({base}, {H.quoted(r'^([a-zA-Z][\w+.-]*://[^/?#]*)(/(?:[^?#]*/)?)?')}, 0)"
    return f"""case when regexp_like({link}, {H.quoted(r'^[a-zA-Z][\w+.-]*:')}) then {link}
        when startswith({link}, '//') then concat(regexp_extract({base}, '^[a-zA-Z][^:]*:', 0), {link})
        when startswith({link}, '/') then concat({origin}, {link})
        else concat({folder}, if(endswith({folder}, '/'), '', '/'), {link}) end"""


def _record(html: str, phrases: list[str]) -> list[Column]:
    """Title, length and indicators (`phrase: n`, those found only) of a page or frame."""
    lower = F.lower(F.col(html))
    counts = F.array(*[F.struct(F.lit(p).alias("p"), T.occurrences(lower, F.lit(p.lower())).alias("n")) for p in phrases])
    found = F.filter(counts, lambda x: x.n > 0)
    title = H.inner_text(H.select_first(html, H.by_tag("title")))
    return [F.coalesce(F.expr(title), F.lit("")).alias("title"), F.length(html).cast("bigint").alias("n_chars"),
            F.transform(found, lambda x: F.concat_ws(": ", x.p, x.n.cast("bigint").cast("string"))).alias("indicators")]


def page_records(pages: DataFrame, phrases: list[str] = POST_INDICATORS, key: str = "page_id", html: str = "html",
                 url: str = "url") -> DataFrame:
    """`key, url, title, n_chars, indicators` of each page."""
    return pages.select(key, url, *_record(html, phrases))


def frame_records(pages: DataFrame, contents: DataFrame | None = None, phrases: list[str] = POST_INDICATORS,
                  key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per embedded frame that can be read: `key, frame, url, title, n_chars, indicators`.

    `frame` is the 0-based position among the frames of the page. A frame holds its own source (`srcdoc`), or its
    address names a page of `contents` (`key, url, html`; by default the pages themselves; of several with an
    address the one with the smallest key). Frames that hold neither have no row. Only the records of framed
    pages are joined, not their text.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(FRAME), F.lit(0))
    tags = pages.select(key, F.col(url).alias("_base"), F.posexplode(found).alias("frame", "tag"))
    rows = tags.select(key, "frame", "_base", F.expr(_frame_attr("tag", "srcdoc")).alias("_html"),
                       F.expr(_frame_attr("tag", "src")).alias("_src"))
    inside = rows.where("_html is not null").select(key, "frame", F.lit("about:srcdoc").alias("url"),
                                                    *_record("_html", phrases))
    linked = rows.where("_html is null and _src is not null").select(
        key, "frame", F.expr(resolved("_src", "_base")).alias("url"))
    others = (pages if contents is None else contents).select(F.col(key).alias("_key"), F.col(url).alias("url"), html)
    wanted = others.join(broadcast_if_small(linked.select("url").distinct()), "url", "left_semi")
    records = wanted.select("url", "_key", *_record(html, phrases)).groupBy("url").agg(
        F.min_by(F.struct("title", "n_chars", "indicators"), "_key").alias("r"))
    outside = linked.join(broadcast_if_small(records), "url").select(key, "frame", "url", "r.*")
    return inside.union(outside)


def links_matching(links: DataFrame, words: list[str], href: str = "href", text: str = "text") -> DataFrame:
    """Links whose address or text contains one of the words."""
    return links.where(T.contains_any(F.col(href), words) | T.contains_any(F.col(text), words))


def post_like(rows: DataFrame, element_id: str = "element_id", css_class: str = "css_class", text: str = "text",
              wide: bool = False) -> DataFrame:
    return rows.where(is_post(F.col(element_id), F.col(css_class), F.col(text), wide))


def short_matches(rows: DataFrame, phrase: str, limit: int = 100, text: str = "text") -> DataFrame:
    """Rows whose trimmed text holds a phrase and stays under `limit` characters."""
    value = F.lower(T.strip(F.col(text)))
    return rows.where(F.contains(value, F.lit(phrase.lower())) & (F.length(value) < limit))


def page_stats(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Length, tag counts and marker flags of each page."""
    def count(needle: str) -> Column:
        # Case-sensitive literal count.
        return (F.length(html_col) - F.length(F.replace(html_col, F.lit(needle), F.lit("")))) / len(needle)

    html_col = F.col(html)
    lower = F.lower(html_col)
    saved = F.contains(lower, F.lit("saved posts"))
    return pages.select(
        key,
        F.length(html_col).cast("bigint").alias("n_chars"),
        *[count(needle).cast("bigint").alias(name) for name, needle in STAT_TAGS.items()],
        *[F.contains(html_col, F.lit(m)).cast("int").alias(name) for name, m in STAT_MARKERS.items()],
        saved.cast("int").alias("has_saved_posts"),
        (saved & F.contains(html_col, F.lit("10+"))).cast("int").alias("has_saved_counter"),
    )


def phrase_counts(pages: DataFrame, phrases: list[str] = KEY_PHRASES, positive_only: bool = False,
                  key: str = "page_id", html: str = "html") -> DataFrame:
    """Occurrences of each phrase on each page; zeros are kept unless `positive_only`."""
    lower = pages.select(key, F.lower(F.col(html)).alias("_text"))
    pairs = F.array(*[
        F.struct(F.lit(p).alias("phrase"), T.occurrences(F.col("_text"), F.lit(p)).alias("n")) for p in phrases
    ])
    counted = lower.select(key, F.inline(pairs))
    return counted.where("n > 0") if positive_only else counted


def element_profile(pages: DataFrame, patterns: dict[str, str], shown: int = 3, few: int = 10,
                    key: str = "page_id", html: str = "html") -> DataFrame:
    """Matches per selector and page; where there are fewer than `few`, the first `shown` start tags too."""
    found = F.array(*[
        F.struct(F.lit(name).alias("selector"),
                 F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0)).alias("tags"))
        for name, pattern in patterns.items()
    ])
    rows = pages.select(key, F.inline(found))
    n = F.size("tags")
    examples = F.when(n < few, F.slice("tags", 1, shown)).otherwise(F.array().cast("array<string>"))
    return rows.select(key, "selector", n.cast("bigint").alias("n"), examples.alias("examples"))


def block_links(pages: DataFrame, pattern: str, shown: int = 3, key: str = "page_id",
                html: str = "html") -> DataFrame:
    """Blocks (whole elements) with a 200-character preview, their number of links and the first few of them."""
    blocks = elements(pages, pattern, key, html, whole=True)
    links = F.regexp_extract_all(F.col("element"), F.lit(r"(?s)<a\s[^>]*>.*?</a>"), F.lit(0))
    rows = blocks.select(key, "pos", "element", links.alias("links"))
    first = H.each(f"slice(links, 1, {shown})", lambda a: (
        f"named_struct('text', {H.inner_text(a)}, 'href', {H.attr(a, 'href')})"))
    return rows.select(key, "pos", F.substring(F.expr(H.inner_text("element")), 1, 200).alias("preview"),
                       F.size("links").cast("bigint").alias("n_links"), F.expr(first).alias("first_links"))
