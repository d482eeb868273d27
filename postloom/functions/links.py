"""Column helpers for links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: address pattern in plain text; (?U) gives the Unicode meaning of \s and \w.
TEXT_URL = r"""(?U)https?://[^\s<>"'\)\],]+|(?<!\w)www\.[^\s<>"'\)\],]+"""


def urls_in_text(text: Column) -> Column:
    """Addresses in plain text, trailing punctuation cut, longer than 10 characters, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(TEXT_URL), F.lit(0))
    trimmed = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+\z", ""))
    return F.filter(trimmed, lambda u: F.length(u) > 10)


def _percent_decode(text: Column) -> Column:
    # A stray % stays as it is: escape it first, so that the strict decoder accepts the text.
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def unwrap_redirect(href: Column) -> Column:
    """Target of a redirect link: first non-blank `url` parameter, form-decoded, then percent-decoded."""
    parameter = F.regexp_extract(href, r"^[^?#]*\?(?:[^#]*?&)??url=([^&#]+)", 1)
    once = _percent_decode(parameter)
    twice = _percent_decode(F.replace(once, F.lit("+"), F.lit("%2B")))
    wrapped = F.contains(href, F.lit("safety/go")) & F.contains(href, F.lit("url=")) & (parameter != "")
    return F.when(wrapped, twice).otherwise(href)


def keep_link(href: Column) -> Column:
    """False for empty links, fragments and profile links."""
    return (href != "") & ~F.startswith(href, F.lit("#")) & ~F.contains(href, F.lit("/in/"))


def outbound_links(hrefs: Column) -> Column:
    """Targets of a list of hrefs: fragments dropped, redirects unwrapped, profile links dropped."""
    raw = F.filter(hrefs, lambda h: (h != "") & ~F.startswith(h, F.lit("#")))
    return F.filter(F.transform(raw, unwrap_redirect),
                    lambda h: (h != "") & ~F.contains(h, F.lit("/in/")))


def merge_links(*lists: Column) -> Column:
    """Distinct union of link lists in first-seen order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in lists]))
