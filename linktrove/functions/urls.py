"""URL columns: cleaning, extraction, routing and ids.

All helpers are native column expressions.  ``clean_urls`` works on an array so
that one task's URLs are cleaned and de-duplicated inside its own row, without a
shuffle; each ``transform`` step names an intermediate value once, which keeps
the expression linear in size.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linktrove import fixed_values as V

_EMPTY_STRINGS = "array<string>"


def computed_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value it uses several times; a one-element transform names the value."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Unicode-aware strip (``trim`` only knows the space character)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _decode(c: Column) -> Column:
    # A stray percent sign would make the decoder fail: escape it first.
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Query string -> array<struct<k, v>>, empty segments dropped, order kept."""
    segments = F.filter(F.split(query, "&"), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.struct(
            _decode(F.regexp_extract(s, "^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(s, "^[^=]*=(?s)(.*)$", 1)).alias("v"),
        ),
    )


def _rebuild_query(query: Column) -> Column:
    kept = F.filter(query_pairs(query), lambda p: ~F.lower(p["k"]).isin(V.TRACKER_PARAMS))
    # Repeated keys are grouped at the place of their first occurrence.
    grouped = computed_once(
        kept,
        lambda pairs: F.flatten(
            F.transform(
                F.array_distinct(F.transform(pairs, lambda p: p["k"])),
                lambda key: F.filter(pairs, lambda p: p["k"] == key),
            )
        ),
    )
    return F.array_join(
        F.transform(grouped, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def _keep_fragment(fragment: Column) -> Column:
    keep = fragment.contains("page=") | fragment.contains("section=") | fragment.startswith("h.")
    return F.when(keep, F.concat(F.lit("#"), fragment)).otherwise("")


def _slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def clean_urls(urls: Column) -> Column:
    """Clean every URL of an array (same length, same order)."""
    trimmed = F.transform(
        urls,
        lambda u: F.replace(
            F.btrim(F.regexp_replace(strip(u), r"[\])]+$", ""), F.lit("<>")),
            F.lit("//x.com"),
            F.lit("//twitter.com"),
        ),
    )
    parts = F.transform(
        trimmed,
        lambda u: F.struct(
            F.regexp_extract(u, "^([a-zA-Z][a-zA-Z0-9+.-]*:)?", 1).alias("scheme"),
            F.regexp_extract(u, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?([^?#]*)", 1).alias("base"),
            F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(u, "(?s)#(.*)$", 1).alias("fragment"),
        ),
    )
    queries = F.transform(
        parts,
        lambda p: F.struct(
            F.concat(F.lower(p["scheme"]), p["base"]).alias("base"),
            F.when(p["query"] == "", F.lit("")).otherwise(_rebuild_query(p["query"])).alias("query"),
            _keep_fragment(p["fragment"]).alias("fragment"),
        ),
    )
    joined = F.transform(
        queries,
        lambda p: F.concat(
            p["base"],
            F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
            p["fragment"],
        ),
    )
    return F.transform(
        joined,
        lambda u: F.when(u.endswith("/") & (_slashes(u) > 2), F.regexp_replace(u, "/+$", "")).otherwise(u),
    )


def clean_url(url: Column) -> Column:
    return clean_urls(F.array(url))[0]


def valid_url(url: Column) -> Column:
    """http(s) scheme and a non-empty host part."""
    return F.coalesce(url.rlike("^(?i:https?)://[^/?#]+"), F.lit(False))


def ordered_union(*arrays: Column) -> Column:
    """Distinct union of arrays, first-seen order; a NULL array counts as empty."""
    empty = F.array().cast(_EMPTY_STRINGS)
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


def _found_urls(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [
        F.regexp_extract_all(text, F.lit(V.PLAIN_URL), F.lit(0)),
        F.regexp_extract_all(text, F.lit(V.MARKDOWN_URL), F.lit(1)),
    ]


def extract_urls(*texts: Column) -> Column:
    """Plain and markdown URLs of the texts: cleaned, distinct, valid, first-seen order.

    Several texts give the ordered union of their URLs.
    """
    found = F.concat(*[f for text in texts for f in _found_urls(text)])
    return F.filter(F.array_distinct(clean_urls(found)), valid_url)


def any_match(c: Column, patterns: list[str]) -> Column:
    """One compiled alternation for 'any of these patterns matches'."""
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def contains_any(c: Column, phrases: list[str]) -> Column:
    """'Any of these literal phrases occurs' as one alternation, so the text is evaluated once."""
    return any_match(c, [r"\Q" + p + r"\E" for p in phrases])


def is_tweet(url: Column) -> Column:
    return any_match(url, [V.TWEET_URL])


def is_video(url: Column) -> Column:
    return any_match(url, ["(?U)" + p for p in V.VIDEO_URLS])


def is_repo(url: Column) -> Column:
    return any_match(url, [V.GITHUB_URL])


def is_notebook(url: Column) -> Column:
    return any_match(url, V.NOTEBOOK_URLS)


def is_pdf(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, "^[^?#]*", 0))
    return F.coalesce(path.endswith(".pdf") | path.contains("arxiv.org/pdf/"), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host without user info and port, NULL when there is none."""
    found = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(found, F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_param(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded; NULL when absent."""
    raw = F.regexp_extract(url_query(url), f"(?:^|&){name}=([^&]+)", 1)
    return _decode(F.nullif(raw, F.lit("")))


def tweet_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, V.TWEET_ID, 1), F.lit(""))


def video_id(url: Column) -> Column:
    on_host = host(url).isin(V.VIDEO_HOSTS)
    found = (
        F.when(url.contains("list=") & ~url.contains("v="), F.lit(None).cast("string"))
        .when(url.contains("youtu.be"), F.btrim(url_path(url), F.lit("/")))
        .when(url.contains("/shorts/"), F.regexp_extract(url, "/shorts/([a-zA-Z0-9_-]+)", 1))
        .when(on_host & (url_path(url) == "/watch"), query_param(url, "v"))
        .when(
            on_host & url_path(url).contains("/embed/"),
            F.regexp_extract(url_path(url), "/embed/(.*?)(?:/embed/|$)", 1),
        )
    )
    return F.nullif(found, F.lit(""))


def playlist_id(url: Column) -> Column:
    return F.when(host(url).isin(V.PLAYLIST_HOSTS), query_param(url, "list"))


def url_kind(url: Column) -> Column:
    """First rule that matches: notebook, video or playlist, tweet, pdf, repo, page."""
    return (
        F.when(~valid_url(url), F.lit("invalid"))
        .when(is_notebook(url), F.lit("notebook"))
        .when(is_video(url) & playlist_id(url).isNotNull(), F.lit("youtube_playlist"))
        .when(is_video(url), F.lit("youtube"))
        .when(is_tweet(url), F.lit("twitter"))
        .when(is_pdf(url), F.lit("pdf"))
        .when(is_repo(url), F.lit("github"))
        .otherwise(F.lit("webpage"))
    )


def collection_kind(url: Column) -> Column:
    channel = reduce(lambda a, b: a | b, [url.contains(p) for p in ("/channel/", "/user/", "/@")])
    return F.when(url.contains("list="), "playlist").when(channel, "channel").otherwise("video")
