"""Column helpers for single post fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.expr import let, unless
from postloom.functions.text import contains_any, strip

# Marks and addresses of post ids.
URN_MARKER = "urn:li:"
POST_URL_PREFIX = "https://www.linkedin.com/feed/update/"
# Fixed value: the connection mark after an author's name, and what follows it.
AUTHOR_TAIL = r"(?s)\s*•\s*(1st|2nd|3rd\+?|Follower).*"
# Marks of a post-like element.
ACTIVITY_MARKER = "urn:li:activity"
POST_CLASS = "feed-shared"
WIDE_CLASS_WORDS = ["post", "update", "activity", "feed", "card", "item"]


def post_url(post_id: Column) -> Column:
    """Address built from an id that carries the URN marker, else empty."""
    return F.when(F.contains(post_id, F.lit(URN_MARKER)),
                  F.concat(F.lit(POST_URL_PREFIX), post_id)).otherwise(F.lit(""))


def surrogate_id(post_id: Column, text: Column, prefix: int | None = None) -> Column:
    """The given id, or the md5 of the whole text where there is none.

    With `prefix` only that many characters are hashed, so different texts with one opening share an id.
    """
    return F.coalesce(unless(post_id, ""), F.md5(text if prefix is None else F.substring(text, 1, prefix)))


def page_file_key(post_id: Column) -> Column:
    """File name stem: letters, digits and `._-` of the id, 50 characters at most; long ids can share one."""
    return F.substring(F.regexp_replace(post_id, r"[^\p{L}\p{N}._-]", ""), 1, 50)


def clean_author(text: Column) -> Column:
    """Author without the connection mark and whatever follows it."""
    return strip(F.regexp_replace(strip(text), AUTHOR_TAIL, ""))


def clean_profile(href: Column) -> Column:
    """Profile address without tracking query; empty if it is no profile address."""
    # The address pattern below is a fixed value.
    def cleaned(address: Column) -> Column:
        canonical = F.regexp_extract(address, r"^(https?://www\.linkedin\.com/in/[^?]+)", 1)
        return F.when(F.contains(address, F.lit("/in/")),
                      F.coalesce(unless(canonical, ""), address)).otherwise(F.lit(""))

    return let(href, cleaned)


def parse_engagement(text: Column) -> Column:
    """`1,234 likes`, `12 reactions`, `56 comments` to a struct of counts; 0 where not stated."""
    def counts(line: Column) -> Column:
        return F.struct(count(line, r"(?i)([\d,]+)\s*(?:like|reaction)").alias("likes"),
                        count(line, r"(?i)([\d,]+)\s*comment").alias("comments"))

    def count(line: Column, pattern: str) -> Column:
        digits = F.translate(F.regexp_extract(line, pattern, 1), ",", "")
        return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))

    return let(text, counts)


def likes_of(engagement: Column) -> Column:
    return F.coalesce(engagement["likes"], F.lit(0))


def comments_of(engagement: Column) -> Column:
    return F.coalesce(engagement["comments"], F.lit(0))


def is_engaged(engagement: Column) -> Column:
    """True where likes or comments are above zero."""
    return (likes_of(engagement) != 0) | (comments_of(engagement) != 0)


def is_post(element_id: Column, css_class: Column, text: Column, wide: bool = False) -> Column:
    """Post-likeness of an element.

    Narrow form: activity marker in the id, post class, or more than 50 characters of text.
    Wide form: activity marker in the id, or one of six words in the class.
    """
    marked = F.contains(F.coalesce(element_id, F.lit("")), F.lit(ACTIVITY_MARKER))
    css = F.coalesce(css_class, F.lit(""))
    if wide:
        return marked | contains_any(css, WIDE_CLASS_WORDS)
    return marked | F.contains(css, F.lit(POST_CLASS)) | (F.length(strip(text)) > 50)
