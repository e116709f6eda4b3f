import random
from urllib.parse import parse_qs, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import urls as U

CLEAN = [
    ("https://x.com/a/status/1?utm_source=z&si=q", "https://twitter.com/a/status/1"),
    ("https://h.com/", "https://h.com"),
    ("https://h.com/p?a=1&b=2&a=3", "https://h.com/p?a=1&a=3&b=2"),
    ("https://h.com/p?k", "https://h.com/p?k="),
    ("https://h.com/d.pdf#page=2", "https://h.com/d.pdf#page=2"),
    ("https://h.com/p#top", "https://h.com/p"),
    ("https://h.com/p#h.abc", "https://h.com/p#h.abc"),
    ("https://h.com/a_(b)", "https://h.com/a_(b"),
    ("  <https://h.com/a/b///>  ", "https://h.com/a/b"),
    ("https://h.com/p?&&a=1&", "https://h.com/p?a=1"),
    ("HTTPS://H.com/P", "https://H.com/P"),
    ("https://h.com/p?UTM_Source=1&q=a%20b+c~*", "https://h.com/p?q=a+b+c~%2A"),
    ("https://h.com/p?q=50%", "https://h.com/p?q=50%25"),
    ("https://h.com/p?q=a=b", "https://h.com/p?q=a%3Db"),
    ("https://x.community/a", "https://twitter.community/a"),
    ("https://h.com/p?#section=2", "https://h.com/p#section=2"),
]


@pytest.mark.parametrize("raw, expected", CLEAN)
def test_clean_url(one, raw, expected):
    assert one(U.clean_url, u=raw) == expected


def test_query_rebuild_matches_standard_library(spark):
    """Random queries against the standard library's parse and encode."""
    rng = random.Random(7)
    chars = "ab1 =&%+~*é/:?.-_"
    urls = [
        "https://h.com/p?" + "".join(rng.choice(chars) for _ in range(rng.randint(0, 14))).replace("%", "%25").replace(" ", "%20") + "x"
        for _ in range(400)
    ]

    def expected(u):
        q = parse_qs(urlsplit(u).query, keep_blank_values=True)
        kept = {k: v for k, v in q.items() if k.lower() not in V.TRACKER_PARAMS}
        encoded = urlencode(kept, doseq=True)
        return "https://h.com/p" + ("?" + encoded if encoded else "")

    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select("u", U.clean_url(F.col("u")).alias("c")).collect()
    assert [(r.u, r.c) for r in rows] == [(u, expected(u)) for u in urls]


def test_clean_is_idempotent_without_brackets(spark):
    urls = [e for _, e in CLEAN if not set(e) & set("()[]")]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(U.clean_url(F.col("u"))).collect()] == urls


EXTRACT = [
    ("go https://h.com/p#section=2 now", ["https://h.com/p"]),
    ("[t](https://h.com/p#section=2)", ["https://h.com/p", "https://h.com/p#section=2"]),
    ("see https://h.com/a.", ["https://h.com/a."]),
    ("<https://h.com/a> and https://h.com/a", ["https://h.com/a"]),
    ("w https://h.com/w_(x)y z", ["https://h.com/w_(x)y"]),
    ("ftp://h.com and https:///x", []),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize("text, expected", EXTRACT)
def test_extract_urls(one, text, expected):
    assert one(U.extract_urls, t=text) == expected


def test_extract_from_a_very_long_text(one):
    """One long URL and a long text pass without deep recursion."""
    long_url = "https://h.com/" + "a" * 200_000
    assert one(U.extract_urls, t="x " * 50_000 + long_url) == [long_url]


def test_extract_two_texts_keeps_first_seen_order(one):
    found = one(lambda a, b: U.extract_urls(a, b), a="https://b.com https://a.com", b="https://a.com https://c.com")
    assert found == ["https://b.com", "https://a.com", "https://c.com"]


KINDS = [
    ("https://arxiv.org/pdf/2504.1", "pdf"),
    ("https://h.com/A.PDF?x=1", "pdf"),
    ("https://youtube.com/shorts/ab", "webpage"),
    ("https://www.youtube.com/watch?v=ab", "youtube"),
    ("https://www.youtube.com/watch?v=ab&list=L", "youtube_playlist"),
    ("https://m.youtube.com/watch?v=ab", "youtube"),
    ("https://youtu.be/ab", "youtube"),
    ("https://twitter.com/a/status/12", "twitter"),
    ("https://github.com/o/r/tree/main", "github"),
    ("https://github.com/o", "webpage"),
    ("https://github.com/o/r/n.ipynb", "notebook"),
    ("https://colab.research.google.com/drive/1", "notebook"),
    ("https://www.kaggle.com/code/x", "notebook"),
    ("https://h.com/watch", "webpage"),
    ("h.com", "invalid"),
]


@pytest.mark.parametrize("url, kind", KINDS)
def test_url_kind(one, url, kind):
    assert one(U.url_kind, u=url) == kind


VIDEO_IDS = [
    ("https://youtube.com/shorts/ab", "ab"),
    ("https://m.youtube.com/watch?v=ab", None),
    ("https://www.youtube.com/playlist?list=L", None),
    ("https://www.youtube.com/watch?t=1&v=a-b_c&list=L", "a-b_c"),
    ("https://youtu.be/ab/?t=3", "ab"),
    ("https://youtu.be/", None),
    ("https://www.youtube.com/embed/xy", "xy"),
    ("https://www.youtube.com/watch?v=", None),
    ("https://h.com/watch?v=ab", None),
]


@pytest.mark.parametrize("url, video", VIDEO_IDS)
def test_video_id(one, url, video):
    assert one(U.video_id, u=url) == video


def test_other_ids(one):
    assert one(U.playlist_id, u="https://m.youtube.com/playlist?list=PL1&x=2") == "PL1"
    assert one(U.playlist_id, u="https://youtu.be/a?list=PL1") is None
    assert one(U.tweet_id, u="https://x.com/a/status/123?s=20") == "123"
    assert one(U.tweet_id, u="https://h.com/a") is None
    assert one(U.collection_kind, u="https://youtube.com/@name") == "channel"
    assert one(U.host, u="https://user@H.com:80/p") == "h.com"
