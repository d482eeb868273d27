"""Column helpers for plain text. All are built-in expressions, so they stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a text trim removes at either end.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
          "\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def preview(col: Column, n: int, trim: bool = False) -> Column:
    """First `n` characters on one line."""
    text = F.translate(F.substring(col, 1, n), "\n", " ")
    return strip(text) if trim else text


def head_items(col: Column, n: int, sep: str | None = None) -> Column:
    """First `n` items of an array, joined with `sep` if given."""
    items = F.slice(col, 1, n)
    return items if sep is None else F.array_join(items, sep)


def title_case(col: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def tokens(col: Column) -> Column:
    """Lower-cased runs of two or more word characters, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def clean_text(col: Column, urls: bool = True, mentions: bool = True, hashtags: bool = True,
               lower: bool = True) -> Column:
    """Optional clean-up before clustering: drop URLs, @mentions and #hashtags, squeeze blanks."""
    if urls:
        col = F.regexp_replace(col, r"https?://[^ \t\r\n]+", " ")
    if mentions:
        col = F.regexp_replace(col, r"@[\p{L}\p{N}_]+", " ")
    if hashtags:
        col = F.regexp_replace(col, r"#[\p{L}\p{N}_]+", " ")
    col = strip(F.regexp_replace(col, r"[ \t\r\n\f]+", " "))
    return F.lower(col) if lower else col


def contains_any(col: Column, words: list[str]) -> Column:
    """Case-insensitive: does the text contain one of the words?"""
    text = F.lower(col)
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word.lower()))
    return hit


def occurrences(col: Column, phrase: Column) -> Column:
    """Count of non-overlapping, case-insensitive occurrences of a phrase."""
    text, needle = F.lower(col), F.lower(phrase)
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (gone / F.length(needle)).cast("bigint")
