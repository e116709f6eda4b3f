"""Text columns: limits, clean-up, names, dates and report fragments."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions.urls import computed_once, strip, url_path


def truncate(text: Column, keep: int, limit: int | None = None) -> Column:
    """Cut to ``keep`` characters plus ``...`` when longer than ``limit`` (default ``keep``)."""
    limit = keep if limit is None else limit
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(keep)), F.lit("..."))).otherwise(text)


def page_prompt_text(text: Column) -> Column:
    return truncate(text, V.PAGE_TEXT_LIMIT)


def transcript_prompt_text(text: Column) -> Column:
    return truncate(text, V.TRANSCRIPT_TEXT_LIMIT)


def comment_text(text: Column) -> Column:
    return truncate(text, V.COMMENT_LIMIT - 3, V.COMMENT_LIMIT)


def playlist_description(text: Column) -> Column:
    return truncate(text, V.PLAYLIST_DESCRIPTION_LIMIT - 3, V.PLAYLIST_DESCRIPTION_LIMIT)


def squeeze_text(text: Column) -> Column:
    """Collapse blank lines and runs of spaces, then strip."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, " {2,}", " "))


def squeeze_pdf_text(text: Column) -> Column:
    """Strip, drop blanks before newlines, collapse blank lines."""
    text = F.regexp_replace(strip(text), r"(?U)\s+\n", "\n")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def content_gate(text: Column) -> Column:
    """Usable page text: more than 50 characters and not an extraction error."""
    usable = (F.length(text) > V.MIN_CONTENT_CHARS) & ~text.startswith(V.EXTRACT_ERROR_PREFIX)
    return F.coalesce(usable, F.lit(False))


def clean_filename(name: Column) -> Column:
    """Lower-case, one underscore for each run of other characters, extension kept as is."""
    # The extension starts at the last dot that is not part of leading dots.
    extension = F.regexp_extract(name, r"^[^/]*?[^./][^/]*?(\.[^./]*)$", 1)
    base = F.left(name, F.length(name) - F.length(extension))
    base = F.regexp_replace(F.lower(base), "[^a-z0-9_]", "_")
    base = F.btrim(F.regexp_replace(base, "_{2,}", "_"), F.lit("_"))
    return F.concat(base, F.lower(extension))


def clean_title(title: Column) -> Column:
    kept = F.regexp_replace(title, r'[<>:"/\\|?*]', "")
    kept = F.replace(F.replace(kept, F.lit(" "), F.lit("_")), F.lit(","), F.lit(""))
    return F.replace(kept, F.lit("__"), F.lit("_"))


def capitalize(text: Column) -> Column:
    """First letter upper, everything else lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def blockquote(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def code_labels(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")


# --- dates ---------------------------------------------------------------------
def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text -> timestamp; unreadable text -> NULL."""
    return F.try_to_timestamp(text)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch of a zone-free timestamp that holds UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def as_utc(ts: Column) -> Column:
    """Zone-free timestamp that holds UTC -> instant, whatever the session zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts))


def from_utc(ts: Column) -> Column:
    """Instant -> zone-free UTC timestamp."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.unix_micros(ts) * F.expr("INTERVAL '0.000001' SECOND")


def utc_display(ts: Column) -> Column:
    """Display of a zone-free timestamp that holds UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def iso_year(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts)


def week_folder(ts: Column) -> Column:
    return F.concat(F.lit("week_"), F.lpad(iso_week(ts).cast("string"), 2, "0"))


# --- artifact names --------------------------------------------------------------
def _bare_host(url: Column) -> Column:
    netloc = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.replace(netloc, F.lit("www."), F.lit(""))


def pdf_filename(url: Column, ts: Column) -> Column:
    base = F.regexp_extract(url_path(url), "([^/]*)$", 1)
    base = F.when(base.endswith(".pdf"), base).otherwise("document.pdf")
    return F.concat_ws("_", _bare_host(url), run_stamp(ts), base)


def page_filename(url: Column, ts: Column) -> Column:
    slug = F.btrim(F.regexp_replace(url_path(url), r"(?U)[^\w]", "_"), F.lit("_"))
    slug = F.when(slug == "", "index").otherwise(slug)
    return F.concat(_bare_host(url), F.lit("_"), slug, F.lit("_"), run_stamp(ts), F.lit(".md"))


def repo_filename(url: Column, ts: Column) -> Column:
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    repo = F.when(F.size(parts) >= 2, F.concat_ws("_", F.element_at(parts, -2), F.element_at(parts, -1)))
    return F.concat(
        F.lit("github_"), F.coalesce(repo, F.lit("unknown_repo")), F.lit("_"), run_stamp(ts), F.lit(".md")
    )


def media_filename(stamp: Column, handle: Column, tweet: Column, index: Column, extension: Column) -> Column:
    safe = F.regexp_replace(F.coalesce(handle, F.lit("unknown_user")), r"(?U)[^\p{L}\p{N}_-]", "_")
    name = F.concat(
        stamp.cast("string"), F.lit("-tweet-"), safe, F.lit("-"), tweet, F.lit("-asset-"),
        (index + 1).cast("string"), F.lit("."), F.coalesce(extension, F.lit("bin")),
    )
    return clean_filename(name)


def video_filename(epoch: Column, title: Column) -> Column:
    return F.concat(epoch.cast("string"), F.lit("_"), clean_title(title), F.lit(".mp4"))


def transcript_filename(epoch: Column, title: Column) -> Column:
    return F.concat(epoch.cast("string"), F.lit("_youtube_"), clean_title(title), F.lit(".txt"))


def media_extension(url: Column, media_type: Column) -> Column:
    """Extension from the URL path when it is a known one, else by media type."""
    tail = F.lower(F.regexp_extract(url_path(url), r"\.([^.]*)$", 1))
    return (
        F.when(tail.isin(V.MEDIA_EXTENSIONS), tail)
        .when(media_type == "photo", "jpg")
        .when(media_type.isin("video", "animated_gif"), "mp4")
    )


def drop_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?[^#]*", "")


# --- report links ------------------------------------------------------------------
def link_kind(url: Column) -> Column:
    """Media word for a bare artifact link."""
    low = F.lower(url)
    return (
        F.when(low.contains(".mp4"), "Video")
        .when(low.rlike(r"\.(jpg|jpeg|png)"), "Photo")
        .when(low.contains(".mp3"), "Audio")
        .otherwise("Media")
    )


#: What a post's content says about its stored media, up to the last location line.
STORED_MEDIA = (r"Media: (\d+) items? detected\n+[^\n]*[uU]ploaded to S3 \d+ media files?:\n((?:- [^\n]*\n)+)"
                r"\s*S3 Locations?:\n((?:\s*- https://\S+(?:\n(?=\s*- https://)|))+)")


def number_media(text: Column) -> Column:
    """Stored media as ``Media: N items detected`` and one line ``- [Type: i](url)`` for every location.

    The type is that of the first line of counts; other types than the fixed words
    take the first of Video and Photo that the counts name, else Media.
    """
    def numbered(found: Column) -> Column:
        counts = F.regexp_extract(found, STORED_MEDIA, 2)
        first = F.regexp_extract(counts, r"^- ([^:\n]*):", 1)
        word = (
            F.when(first.isin(V.MEDIA_WORDS), first)
            .when(counts.contains("Video:"), "Video").when(counts.contains("Photo:"), "Photo").otherwise("Media")
        )
        urls = F.regexp_extract_all(F.regexp_extract(found, STORED_MEDIA, 3), F.lit(r"- (https://\S+)"), F.lit(1))
        lines = F.transform(urls, lambda u, i: F.concat(
            F.lit("- ["), word, F.lit(": "), (i + 1).cast("string"), F.lit("]("), u, F.lit(")\n")))
        return F.concat(F.lit("Media: "), F.regexp_extract(found, STORED_MEDIA, 1), F.lit(" items detected\n\n"), F.array_join(lines, ""))

    def replaced(t: Column) -> Column:
        blocks = F.array_distinct(F.regexp_extract_all(t, F.lit(STORED_MEDIA), F.lit(0)))
        return F.when(t.contains("S3 Location"), F.aggregate(blocks, t, lambda acc, b: F.replace(acc, b, numbered(b)))).otherwise(t)

    return computed_once(text, replaced)


def label_bare_links(text: Column) -> Column:
    """Turn bare ``- https://...`` lines and ``/name`` links into markdown links."""
    bare = r"(?m)^- (https://(?=[^\s]*{ext})[^\s]+)"
    for word, ext in (("Video", r"(?i:\.mp4)"), ("Photo", r"(?i:\.(?:jpg|jpeg|png))"), ("Audio", r"(?i:\.mp3)")):
        text = F.regexp_replace(text, bare.format(ext=ext), f"- [{word}]($1)")
    text = F.regexp_replace(text, r"(?m)^- (https://[^\s]+)", "- [Media]($1)")
    # "/name" links stand only in the link list that ends a tweet block.
    marker = "URLs in tweet:\n"
    names = r"(?U)(?m)^\s*- /(\w+)$"

    def link_names(t: Column) -> Column:
        start = F.instr(t, marker) + F.lit(len(marker) - 1)
        tail = F.regexp_replace(F.substr(t, start + 1), names, " - [$1](https://x.com/$1)")
        return F.when(t.contains(marker), F.concat(F.left(t, start), tail)).otherwise(t)

    return computed_once(text, link_names)
