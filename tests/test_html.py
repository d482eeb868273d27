import pytest
from pyspark.sql import functions as F

from postloom.functions import html as H
from postloom.operators import extract, pages


def ev(spark, sql, text):
    return spark.createDataFrame([(text,)], "h string").select(F.expr(sql).alias("v")).first()["v"]


@pytest.mark.parametrize("html,want", [
    ("<div a><div>x</div>y</div>z</div>", "<div a><div>x</div>y</div>"),
    ("<div>never <b>closed</b>", "<div>never <b>closed</b>"),
    ("<img src='x'>tail", "<img src='x'>"), ("<p/>tail", "<p/>"),
    ("<a>1</a><a>2</a>", "<a>1</a>"), ("<DIV>x</div>y", "<DIV>x</div>"), ("text", None),
])
def test_balanced(spark, html, want):
    assert ev(spark, H.balanced("h"), html) == want


def test_select_all_keeps_nested_elements_whole(spark):
    html = '<p class="w">a<p class="w">b</p>c</p><i class="w">d</i>'
    got = ev(spark, H.select_all("h", H.by_class("w")), html)
    assert got == ['<p class="w">a<p class="w">b</p>c</p>', '<p class="w">b</p>', '<i class="w">d</i>']
    assert ev(spark, H.longest_text("h", [H.by_class("w")]), html) == "a b c"


def test_longest_text_first_wins_tie(spark):
    html = '<b class="x">one</b><b class="y">two</b><b class="x">zz</b>'
    assert ev(spark, H.longest_text("h", [H.by_class("y"), H.by_class("x")]), html) == "two"


def test_class_selector_matches_whole_words(spark):
    assert ev(spark, H.select_first("h", H.by_class("text")), '<p class="my-text"></p><p class="a text b">x</p>') \
        == '<p class="a text b">x</p>'


@pytest.mark.parametrize("tag,name,default,want", [
    ('<a data-id="1" id="2">', "id", "", "2"), ("<a id='3'>", "id", "", "3"), ('<a id="">', "id", "No id", "No id"),
    ("<a>", "src", "No src", "No src"), ('<a href="?a=1&amp;b=2">', "href", "", "?a=1&b=2"),
    ('<a><b id="x">', "id", "", ""),
])
def test_attr(spark, tag, name, default, want):
    assert ev(spark, H.attr("h", name, default), tag) == want


def test_inner_text(spark):
    html = "<p>a<b>b</b> &amp;lt; &lt;\n\n c</p><p>d</p><script>x<y</script><!-- <p>no</p> --><style>z{}</style>"
    assert ev(spark, H.inner_text("h"), html) == "ab &lt; < c d"


CARD = (
    '<html><li><div class="q" data-chameleon-result-urn="urn:li:activity:{n}">'
    '<div class="entity-result__content-actor"><a href="https://www.linkedin.com/in/ann?trk=1">'
    '<span dir="ltr"><span><span>{author}</span></span></span></a></div>{body}</div></li><div class="video"></div></html>'
)


def posts(spark, *htmls):
    rows = spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")
    return [r.asDict(recursive=True) for r in extract.extract_posts(rows).orderBy("page_id", "pos").collect()]


def test_extract_posts(spark):
    body = ('<p class="entity-result__content-summary">…</p><div class="feed-shared-text">See www.example.org/x.</div>'
            '<i class="entity-result__content-image"></i><i class="feed-shared-article"></i>'
            '<div class="entity-result__embedded-object"><b class="entity-result__embedded-object-title">Top</b>'
            '<a href="https://www.linkedin.com/feed/update/u">x</a></div>')
    got = posts(spark, CARD.format(n=7, author="Ann • 2nd", body=body))
    assert len(got) == 1
    post = got[0]
    assert post["id"] == "urn:li:activity:7" and post["url"].endswith("urn:li:activity:7")
    assert post["author"] == "Ann" and post["author_profile"] == "https://www.linkedin.com/in/ann"
    assert post["content"] == "See www.example.org/x.\n\n[Top]"
    assert post["post_type"] == "article"  # article before image; the later video lies outside the post
    assert post["links"] == ["www.example.org/x", "https://www.linkedin.com/feed/update/u"]
    assert post["engagement"] == {"likes": 0, "comments": 0} and post["cluster_id"] is None


def test_extract_posts_defaults(spark):
    got = posts(spark, CARD.format(n=1, author=" • 1st", body="<div class='linked-area'>single quotes</div>"
                                   '<div class="linked-area">area</div>') * 2)
    assert [p["author"] for p in got] == ["Unknown", "Unknown"]
    assert [p["content"] for p in got] == ["single quotes"] * 2 and [p["pos"] for p in got] == [0, 1]
    assert got[0]["post_type"] == "text"


def test_extract_detail(spark):
    html = ('<div class="feed-shared-text">short</div><div class="break-words">the longest text'
            '<a href="https://lnkd.in/a">l</a></div><a href="https://l.com/safety/go?url=https%3A%2F%2Fx.org">r</a>'
            '<div class="update-components-text"><a href="#x">h</a><a href="https://y/in/me">p</a>'
            '<a href="https://z.org">z</a></div>')
    row = extract.extract_detail(spark.createDataFrame([("1", html)], "id string, html string")).first()
    assert row["detail_content"] == "the longest textl"
    assert row["detail_links"] == ["https://lnkd.in/a", "https://x.org", "https://z.org"]


def test_page_profiles(spark):
    rows = spark.createDataFrame([(1, '<div><article>Saved Posts 10+</article></div><iframe src="f" id="i"></iframe>')],
                                 "page_id bigint, html string")
    stats = pages.page_stats(rows).first()
    assert (stats["n_div"], stats["n_article"], stats["has_saved_posts"], stats["has_saved_counter"]) == (1, 1, 1, 1)
    frame = pages.frames(rows).first()
    assert (frame["src"], frame["name"], frame["id"], frame["classes"]) == ("f", "No name", "i", "No classes")
    counts = {r["phrase"]: r["n"] for r in pages.phrase_counts(rows, ["saved posts", "10+", "nope"]).collect()}
    assert counts == {"saved posts": 1, "10+": 1, "nope": 0}
    assert pages.phrase_counts(rows, ["nope"], positive_only=True).count() == 0


def test_frame_records(spark):
    top = ('<title>Top</title><iframe class="x>y" src="/a?b=1&amp;c=2"></iframe><IFRAME name=\'n\' srcdoc="<title>In &amp; '
           'out</title><a href=\'u\'>Feed-Shared post, POST</a>" src="/b"></IFRAME><iframe data-src="/a"></iframe>'
           '<iframe src="rel.html"/><iframe src="https://else.org/"></iframe><iframe src="//x.org/p"></iframe>')
    rows = spark.createDataFrame([
        (1, "https://x.org/dir/top.html", top), (2, "https://x.org/a?b=1&c=2", "<title>A</title>saved posts"),
        (4, "https://x.org/dir/rel.html", "second copy"), (3, "https://x.org/dir/rel.html", "first post"),
        (5, "https://x.org/p", None), (6, "https://x.org/none", "<p>no frames"), (7, None, '<iframe src="/a"></iframe>')],
        "page_id bigint, url string, html string")
    got = {(r["page_id"], r["frame"]): (r["url"], r["title"], r["n_chars"], r["indicators"])
           for r in pages.frame_records(rows).collect()}
    assert got == {
        (1, 0): ("https://x.org/a?b=1&c=2", "A", 27, ["saved posts: 1", "post: 1"]),
        (1, 1): ("about:srcdoc", "In & out", 61, ["feed-shared: 1", "post: 2"]),
        (1, 3): ("https://x.org/dir/rel.html", "", 10, ["post: 1"]),
        (1, 5): ("https://x.org/p", "", None, [])}
    own = {r["page_id"]: r for r in pages.page_records(rows).collect()}
    assert len(own) == 7 and own[1]["title"] == "Top" and own[6]["indicators"] == []
    assert pages.frame_records(rows.limit(0)).count() == 0


def test_post_info_uses_the_first_selector_with_posts(spark):
    long = "w" * 60
    rows = spark.createDataFrame([
        (1, '<div class="feed-shared-update" data-id="urn:li:activity:5"><b class="feed-shared-actor__name">Ann</b>'
            f'<p class="update-components-text">{"c" * 250}</p></div><article>{long}</article>'),
        (2, f"<article>short</article><article>{long}</article>"),
        (3, "<p>nothing</p>"),
    ], "page_id bigint, html string")
    got = {(r["page_id"], r["pos"]): r for r in extract.extract_post_info(rows).collect()}
    assert set(got) == {(1, 0), (2, 0)}
    assert got[1, 0]["id"] == "urn:li:activity:5" and got[1, 0]["author"] == "Ann"
    assert got[1, 0]["content_preview"] == "c" * 200 and got[1, 0]["file_key"] == "urnliactivity5"
    assert got[2, 0]["author"] == "unknown" and len(got[2, 0]["id"]) == 32


def test_selectors_take_any_case_and_quotes(spark):
    html = "<DIV data-class='w' CLASS='a w'>one</DIV><p Data-Id='urn:x'>two</p><i data-class=\"w\">no</i>"
    assert ev(spark, H.select_all("h", H.by_class("w")), html) == ["<DIV data-class='w' CLASS='a w'>one</div>"]
    assert ev(spark, H.select_all("h", H.by_attr("data-id", "urn")), html) == ["<p Data-Id='urn:x'>two</p>"]
    assert ev(spark, H.attr(H.select_first("h", H.by_tag("p")), "data-id"), html) == "urn:x"


def test_steps_search_all_containers(spark):
    html = '<div class="c"><a>1</a></div><div class="c"><a><b>x</b></a><a>2</a></div>'
    assert ev(spark, H.select_first("h", H.by_class("c"), H.by_tag("a"), H.by_tag("b")), html) == "<b>x</b>"
    assert ev(spark, H.select_first("h", H.by_class("c"), H.by_tag("i")), html) is None


@pytest.mark.parametrize("text,want", [
    ("it&#8217;s caf&eacute; &#x1F600;&#65;", "it’s café 😀A"), ("&amp;#65; &#0; &#55296; &#x; &#zz;", "&#65; &#0; &#55296; &#x; &#zz;"),
])
def test_entities(spark, text, want):
    assert ev(spark, H.inner_text("h"), text) == want


def test_author_after_an_image_link(spark):
    html = ("<div data-chameleon-result-urn='urn:li:activity:7'><div class='entity-result__content-actor'>"
            "<a href='/x'><img src='i'></a><a href='https://www.linkedin.com/in/bo?x=1'><span dir='ltr'>Bo</span></a></div>"
            "<p class='entity-result__content-summary'>Text</p></div>")
    got = posts(spark, html)
    assert [(p["author"], p["content"], p["id"]) for p in got] == [("Bo", "Text", "urn:li:activity:7")]
