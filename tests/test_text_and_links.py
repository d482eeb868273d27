import hashlib

import pytest
from pyspark.sql import functions as F

from postloom.functions import links as L
from postloom.functions import records as R
from postloom.functions import text as T


@pytest.mark.parametrize("text,want", [
    ("see https://example.com/a, and more", ["https://example.com/a"]),
    ("(www.site-one.org). x", ["www.site-one.org"]),
    ("awww.notalink.org is a word", []),
    ("http://a.b is short", []),
    ("https://example.com/x?!. https://example.com/x?!.", ["https://example.com/x"] * 2),
    ("<https://example.com/q>'https://example.org/r'", ["https://example.com/q", "https://example.org/r"]),
    ("éwww.accent.org and  www.blank.org", ["www.blank.org"]),
])
def test_urls_in_text(value, text, want):
    assert value(L.urls_in_text, text) == want


@pytest.mark.parametrize("href,want", [
    ("https://www.linkedin.com/safety/go?url=https%3A%2F%2Fexample.com%2Fa&trk=x", "https://example.com/a"),
    ("https://www.linkedin.com/safety/go?url=https%253A%252F%252Fexample.com", "https://example.com"),
    ("https://www.linkedin.com/safety/go?trk=x&url=a%2Bb", "a+b"),
    ("https://www.linkedin.com/safety/go?url=a+b", "a b"),
    ("https://www.linkedin.com/safety/go?url=&url=second", "second"),
    ("https://www.linkedin.com/safety/go?url=", "https://www.linkedin.com/safety/go?url="),
    ("https://www.linkedin.com/safety/go?url=50%25%ZZ%41", "50%%ZZA"),
    ("https://www.linkedin.com/safety/go?myurl=x", "https://www.linkedin.com/safety/go?myurl=x"),
    ("https://www.linkedin.com/safety/go?a=b#url=x", "https://www.linkedin.com/safety/go?a=b#url=x"),
    ("https://example.com/?url=x", "https://example.com/?url=x"),
])
def test_unwrap_redirect(value, href, want):
    assert value(L.unwrap_redirect, href) == want


def test_outbound_links(value):
    hrefs = ["", "#top", "https://x/in/me", "https://l.com/safety/go?url=https%3A%2F%2Fx%2Fin%2Fme", "https://ok.org"]
    assert value(lambda c: L.outbound_links(F.split(c, " ")), " ".join(hrefs)) == ["https://ok.org"]


def test_merge_links_keeps_first_seen_order(value):
    got = value(lambda c: L.merge_links(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"),
                                        F.array(c, F.lit("b"), F.lit("c"))), "a")
    assert got == ["b", "a", "c"]


@pytest.mark.parametrize("text,want", [
    ("Ann Lee • 2nd", "Ann Lee"), ("Ann Lee\n • 3rd+\nEngineer", "Ann Lee"), (" Ann • Follower", "Ann"),
    ("Ann • friend", "Ann • friend"), ("• 1st", ""),
])
def test_clean_author(value, text, want):
    assert value(R.clean_author, text) == want


@pytest.mark.parametrize("href,want", [
    ("https://www.linkedin.com/in/ann?trk=1", "https://www.linkedin.com/in/ann"),
    ("http://www.linkedin.com/in/ann", "http://www.linkedin.com/in/ann"),
    ("/in/ann?x=1", "/in/ann?x=1"), ("https://www.linkedin.com/company/x", ""), ("", ""),
])
def test_clean_profile(value, href, want):
    assert value(R.clean_profile, href) == want


@pytest.mark.parametrize("text,want", [
    ("1,234 likes 56 comments", (1234, 56)), ("7 Reactions", (7, 0)), ("", (0, 0)), ("likes , comment", (0, 0)),
])
def test_parse_engagement(value, text, want):
    assert tuple(value(R.parse_engagement, text)) == want


def test_ids(value):
    text = "é" * 120
    assert value(lambda c: R.surrogate_id(F.lit(""), c), text) == hashlib.md5(text.encode()).hexdigest()
    assert value(lambda c: R.surrogate_id(F.lit(""), c, 100), text) == hashlib.md5(("é" * 100).encode()).hexdigest()
    assert value(lambda c: R.surrogate_id(F.lit("given"), c), text) == "given"
    assert value(R.post_url, "urn:li:activity:1") == "https://www.linkedin.com/feed/update/urn:li:activity:1"
    assert value(R.post_url, "abc") == ""
    assert value(R.page_file_key, "urn:li:a/b c_d-é.9" + "x" * 60) == ("urnliabc_d-é.9" + "x" * 60)[:50]


@pytest.mark.parametrize("text", ["the quick & brown's 3rd_word ßa éa", "", "MIXED case 9lives"])
def test_title_case(value, text):
    assert value(T.title_case, text) == text.title()


def test_preview(value):
    text = "  first\nline" + "x" * 50
    assert value(lambda c: T.preview(c, 12), text) == text[:12].replace("\n", " ")
    assert value(lambda c: T.preview(c, 12, trim=True), text) == text[:12].replace("\n", " ").strip()


def test_tokens_and_counts(value):
    assert value(T.tokens, "A bb, C_d 42 ÉÀ x") == ["bb", "c_d", "42", "éà"]
    assert value(lambda c: T.occurrences(c, F.lit("Aa")), "aaaa aA") == 3
    assert value(T.clean_text, "Hi @bob see https://x.org/a  #Tag\nBye") == "hi see bye"


def test_is_post(spark):
    rows = spark.createDataFrame([
        (1, "urn:li:activity:9", "", ""), (2, "", "x feed-shared-y", ""), (3, "", "", "t" * 51), (4, "", "", " " * 60),
        (5, None, None, "short"), (6, "", "My-CARD", ""),
    ], "n int, element_id string, css_class string, text string")
    from postloom.operators.pages import post_like

    assert {r["n"] for r in post_like(rows).collect()} == {1, 2, 3}
    assert {r["n"] for r in post_like(rows, wide=True).collect()} == {1, 2, 6}
