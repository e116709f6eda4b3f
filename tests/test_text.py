import pytest
from pyspark.sql import functions as F

from linktrove.functions import html as H
from linktrove.functions import text as T
from linktrove.operators import pages as P


def test_names(one):
    assert one(T.clean_filename, n="A  b--C.TXT") == "a_b_c.txt"
    assert one(T.clean_filename, n="no extension") == "no_extension"
    assert one(T.clean_filename, n="a.b.JPG") == "a_b.jpg"
    assert one(T.clean_title, n="a: b, c") == "a_b_c"
    assert one(T.capitalize, n="youtube_playlist") == "Youtube_playlist"
    assert one(T.digits_only, n="1,234 commits") == "1234"
    assert one(T.blockquote, n="a\nb") == "> a\n> b"


def test_artifact_names(one):
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    assert one(lambda u: T.page_filename(u, stamp), u="https://www.h.com/a/b-c/") == "h.com_a_b_c_20240506_070809.md"
    assert one(lambda u: T.page_filename(u, stamp), u="https://h.com") == "h.com_index_20240506_070809.md"
    assert one(lambda u: T.pdf_filename(u, stamp), u="https://h.com/x/p.pdf?q") == "h.com_20240506_070809_p.pdf"
    assert one(lambda u: T.pdf_filename(u, stamp), u="https://h.com/x/") == "h.com_20240506_070809_document.pdf"
    assert one(lambda u: T.repo_filename(u, stamp), u="https://github.com/o/r/") == "github_o_r_20240506_070809.md"
    assert one(lambda h: T.media_filename(F.lit(5), h, F.lit("9"), F.lit(0), F.lit("JPG")), h="A b") == "5_tweet_a_b_9_asset_1.jpg"


def test_limits(one):
    assert one(T.comment_text, t="x" * 101) == "x" * 97 + "..."
    assert one(T.comment_text, t="x" * 100) == "x" * 100
    assert one(T.page_prompt_text, t="é" * 14001) == "é" * 14000 + "..."
    assert one(T.content_gate, t="x" * 50) is False
    assert one(T.content_gate, t="x" * 51) is True
    assert one(T.content_gate, t="[Error: " + "x" * 60) is False
    assert one(T.content_gate, t=None) is False


def test_squeeze(one):
    assert one(T.squeeze_text, t="  a\n\n\n\nb   c ") == "a\n\nb c"
    assert one(T.squeeze_pdf_text, t="a  \n\n\n b") == "a\n b"


def test_dates(one):
    week = lambda s: F.concat_ws("-", T.iso_year(s.cast("timestamp_ntz")), T.week_folder(s.cast("timestamp_ntz")))
    assert one(week, s="2024-12-30 00:00:00") == "2025-week_01"
    assert one(lambda s: T.utc_display(T.from_utc(T.iso_timestamp(s))), s="2024-01-02T03:04:05.000Z") == "2024-01-02 03:04:05 UTC"
    assert one(T.iso_timestamp, s="nonsense") is None
    back = lambda s: T.from_utc(T.as_utc(s.cast("timestamp_ntz"))).cast("string")
    assert one(back, s="2024-03-31 02:30:00.123456") == "2024-03-31 02:30:00.123456"


def test_media_extension(one):
    assert one(lambda u: T.media_extension(u, F.lit("photo")), u="https://h.com/a.WEBP?x=1") == "webp"
    assert one(lambda u: T.media_extension(u, F.lit("photo")), u="https://h.com/a.bin") == "jpg"
    assert one(lambda u: T.media_extension(u, F.lit("video")), u="https://h.com/a") == "mp4"
    assert one(T.drop_query, u="https://h.com/a.mp4?tag=10") == "https://h.com/a.mp4"


def test_bare_links(one):
    text = "Intro\nURLs in tweet:\n - /name\n - https://e.com\n- https://h.com/a.mp4\n- https://h.com/a.PNG\n- https://h.com/x"
    assert one(T.label_bare_links, t=text) == (
        "Intro\nURLs in tweet:\n - [name](https://x.com/name)\n - https://e.com\n- [Video](https://h.com/a.mp4)\n"
        "- [Photo](https://h.com/a.PNG)\n- [Media](https://h.com/x)"
    )


PAGE = (
    "<html lang='en'><head><title>T &amp; U</title></head><body><script>var t='</p>';</script><!-- <p>no</p> -->"
    "<h1>Head</h1><p>One <b>two</b><br>three&nbsp;&lt;x&gt; &#8364;&#x2014;<p>Four <a href=\"/a\">link</a>"
    "<ul><li>a<li>b</ul><img alt='pic' src='/i.png'><p>cut <a hre"
)


def test_html_to_text(one):
    assert one(H.html_to_text, h=PAGE) == "Head\n\nOne two\nthree <x> €&#x2014;\n\nFour link\n\n- a\n- b\n\ncut"


def test_html_to_markdown(one):
    assert one(H.html_to_markdown, h=PAGE) == (
        "# Head\n\nOne **two**  \nthree <x> €&#x2014;\n\nFour [link](/a)\n\n* a\n* b\n\n![pic](/i.png)\n\ncut"
    )


@pytest.mark.parametrize("href, expected", [
    ("/x", "https://h.com/x"),
    ("x/y", "https://h.com/a/x/y"),
    ("../x?q=1", "https://h.com/x?q=1"),
    ("./x", "https://h.com/a/x"),
    ("//o.com/x", "https://o.com/x"),
    ("https://o.com", "https://o.com"),
    ("mailto:a@b.c", "mailto:a@b.c"),
    ("#f", "https://h.com/a/b?c=1#f"),
    ("?d=2", "https://h.com/a/b?d=2"),
])
def test_resolve_link(one, href, expected):
    assert one(H.resolve_link, h=href, b="https://h.com/a/b?c=1") == expected


def test_page_fields_and_links(spark):
    pages = spark.createDataFrame([(1, "https://h.com/a/b", PAGE), (2, "https://h.com", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in P.page_fields(pages).collect()}
    assert rows[1].title == "T & U" and rows[1].language == "en" and rows[1].headings == ["Head"]
    assert (rows[1].n_links, rows[1].n_images, rows[1].n_paragraphs) == (1, 1, 3)
    assert rows[2].title == "Untitled Webpage" and rows[2].n_links == 0
    assert [(r.page_id, r.href, r.text, r.url) for r in P.page_links(pages).collect()] == [(1, "/a", "link", "https://h.com/a")]


def test_repo_fields(spark):
    html = (
        '<strong itemprop="name"><a href="/o/r">r</a></strong><p class="f4 mb-3"> About it </p>'
        '<a href="/o/r/stargazers"><span class="text-bold">1.2k</span></a>'
        '<li class="d-inline"><a class="d-inline-flex flex-items-center"><span class="text-bold">Python</span></a></li>'
        '<article class="markdown-body entry"><p>Read me</p></article>'
    )
    pages = spark.createDataFrame([(1, "https://github.com/o/r", html), (2, "https://github.com/o/q", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in P.repo_fields(pages).collect()}
    assert (rows[1].title, rows[1].description, rows[1].stars, rows[1].forks) == ("r", "About it", "1.2k", "0")
    assert rows[1].languages == ["Python"] and rows[1].readme == "Read me"
    assert rows[2].title == "q" and rows[2].commit_count == "Unknown"


def test_tweet_links(spark):
    links = spark.createDataFrame(
        [("/hashtag/x", None), ("/@a", None), ("https://t.co/1", "https://full.com"), ("https://t.co/2", None), ("/name", "t"), ("", None)],
        "href string, title string",
    )
    assert [r.link for r in P.tweet_links(links).collect()] == ["https://full.com", "https://t.co/2", "/name"]
