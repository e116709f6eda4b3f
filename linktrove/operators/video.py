"""Videos, comments, transcripts and playlists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove import schemas
from linktrove.functions import text as T
from linktrove.operators.grouping import PART_ROWS, first_per_key, ordered_parts


def _count(c: Column) -> Column:
    return c.try_cast("bigint")


def _typed(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.struct(ddl)])


# --- raw API items -> flat rows ---------------------------------------------------
def video_projection(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Video item JSON (with its request key ``video_id``) -> ``videos``."""
    rows = raw.select("video_id", F.from_json(json_col, schemas.VIDEO_ITEM_DDL).alias("v"))
    s, st, d = "v.snippet", "v.statistics", "v.contentDetails"
    return _typed(rows.select(
        "video_id",
        F.col(f"{s}.title").alias("title"),
        F.coalesce(f"{s}.description", F.lit("")).alias("description"),
        F.col(f"{s}.publishedAt").alias("published_at"),
        F.col(f"{s}.channelId").alias("channel_id"),
        F.col(f"{s}.channelTitle").alias("channel_title"),
        F.coalesce(f"{s}.tags", F.array().cast("array<string>")).alias("tags"),
        F.col(f"{s}.categoryId").alias("category_id"),
        F.col(f"{s}.thumbnails").alias("thumbnails"),
        _count(F.col(f"{st}.viewCount")).alias("view_count"),
        _count(F.col(f"{st}.likeCount")).alias("like_count"),
        _count(F.col(f"{st}.commentCount")).alias("comment_count"),
        F.col(f"{d}.duration").alias("duration"),
        F.col(f"{d}.definition").alias("definition"),
        (F.coalesce(f"{d}.caption", F.lit("false")) == "true").alias("caption"),
    ), schemas.VIDEOS)


def comment_projection(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Comment item JSON with ``video_id`` and ``position`` -> ``comments``."""
    rows = raw.select("video_id", "position", F.from_json(json_col, schemas.COMMENT_ITEM_DDL).alias("v"))
    c = "v.snippet.topLevelComment.snippet"
    return _typed(rows.select(
        "video_id", "position",
        F.col(f"{c}.authorDisplayName").alias("author"),
        F.coalesce(f"{c}.textDisplay", F.lit("")).alias("text"),
        F.col(f"{c}.publishedAt").alias("published_at"),
        F.coalesce(f"{c}.likeCount", F.lit(0)).alias("like_count"),
        F.col(f"{c}.authorChannelId.value").alias("author_channel_id"),
    ), schemas.COMMENTS)


def channel_projection(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    rows = raw.select("channel_id", F.from_json(json_col, schemas.CHANNEL_ITEM_DDL).alias("v"))
    s, st, b = "v.snippet", "v.statistics", "v.brandingSettings.channel"
    return _typed(rows.select(
        "channel_id",
        F.col(f"{s}.title").alias("title"),
        F.coalesce(f"{s}.description", F.lit("")).alias("description"),
        F.col(f"{s}.customUrl").alias("custom_url"),
        F.col(f"{s}.publishedAt").alias("published_at"),
        F.col(f"{s}.thumbnails").alias("thumbnails"),
        F.col(f"{s}.country").alias("country"),
        _count(F.col(f"{st}.viewCount")).alias("view_count"),
        _count(F.col(f"{st}.subscriberCount")).alias("subscriber_count"),
        _count(F.col(f"{st}.videoCount")).alias("video_count"),
        F.col(f"{b}.bannerImageUrl").alias("banner_image"),
        F.col(f"{b}.keywords").alias("keywords"),
    ), schemas.CHANNELS)


def language_projection(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Transcript list item JSON with ``video_id`` -> ``transcript_languages``."""
    rows = raw.select("video_id", F.from_json(json_col, schemas.LANGUAGE_ITEM_DDL).alias("v"))
    return _typed(rows.select(
        "video_id", "v.language_code", F.col("v.language").alias("language_name"),
        F.coalesce("v.is_generated", F.lit(False)).alias("is_auto_generated"),
    ), schemas.TRANSCRIPT_LANGUAGES)


def playlist_items(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Video items of a playlist; positions count from 1."""
    rows = raw.select("playlist_id", F.from_json(json_col, schemas.PLAYLIST_ITEM_DDL).alias("v"))
    return rows.where(F.col("v.snippet.resourceId.kind") == "youtube#video").select(
        "playlist_id",
        F.coalesce("v.snippet.title", F.lit("N/A")).alias("title"),
        F.col("v.snippet.resourceId.videoId").alias("video_id"),
        (F.coalesce("v.snippet.position", F.lit(-1)) + 1).alias("position"),
    )


# --- choices per video ---------------------------------------------------------------
def top_comments(comments: DataFrame, k: int = V.TOP_COMMENTS, key: str = "video_id", order: list[Column] | None = None) -> DataFrame:
    """First ``k`` comments in API order, numbered from 1, long texts cut."""
    ranked = first_per_key(comments, [key], order or [F.col("position")], k, rank="number")
    return ranked.withColumn("text", T.comment_text(F.col("text")))


def preview_n(items: DataFrame, n: int = V.PLAYLIST_PREVIEW, key: str = "playlist_id", order: list[Column] | None = None) -> DataFrame:
    """First ``n`` items of a playlist."""
    return first_per_key(items, [key], order or [F.col("position")], n, rank="number")


def languages_by_name(languages: DataFrame) -> DataFrame:
    """Languages of a video sorted by name.

    Rows are made distinct first, so a video's list is bounded by the number of
    languages there are.
    """
    distinct = languages.select("video_id", "language_name", "language_code", "is_auto_generated").distinct()
    return distinct.groupBy("video_id").agg(
        F.sort_array(F.collect_list(F.struct("language_name", "language_code", "is_auto_generated"))).alias("languages")
    )


def language_available(requests: DataFrame, languages: DataFrame) -> DataFrame:
    """Transcript requests with ``available``; others get the error and the alternatives.

    ``requests``: video_id, language.
    """
    known = languages.groupBy("video_id").agg(F.sort_array(F.collect_set("language_code")).alias("codes"))
    joined = requests.join(known, "video_id", "left")
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    ok = F.array_contains(codes, F.col("language"))
    return joined.select(
        *requests.columns,
        ok.alias("available"),
        F.when(~ok, "language_unavailable").alias("error"),
        F.when(~ok, codes).alias("alternatives"),
    )


# --- transcripts -----------------------------------------------------------------------
def transcript_text(segments: DataFrame, part_rows: int = PART_ROWS, key: str = "video_id", seq: str = "seq") -> DataFrame:
    """Segments joined by newline in order, with the length of the whole transcript.

    A transcript of up to ``part_rows`` segments is one row (part 0).  A longer
    one is cut into ordered parts; joined by newline they are the transcript.
    """
    parts = ordered_parts(segments, [key], seq, F.coalesce("text", F.lit("")), "_lines", part_rows)
    return parts.join(transcript_length(segments, key), key).select(
        key, "part", F.array_join("_lines", "\n").alias("text"), "n_chars"
    )


def transcript_length(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Length of the joined text by counting, without building it."""
    return segments.groupBy(key).agg(
        (F.sum(F.length(F.coalesce("text", F.lit("")))) + F.count(F.lit(1)) - 1).alias("n_chars")
    )


# --- text blocks ---------------------------------------------------------------------------
def _or_na(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value, F.lit("  "))


def _with_channel_and_comments(videos: DataFrame, channels: DataFrame, comments: DataFrame) -> DataFrame:
    """Videos with one row of channel columns and a list of at most five comments."""
    top = (
        top_comments(comments)
        .groupBy("video_id")
        .agg(F.sort_array(F.collect_list(F.struct("number", "author", "text"))).alias("top_comments"))
    )
    fields = ("title", "subscriber_count", "view_count", "video_count")
    one_each = channels.groupBy("channel_id").agg(F.min(F.struct(*fields)).alias("c")).select("channel_id", "c.*")
    ch = one_each.select(
        "channel_id", F.lit(True).alias("_channel"),
        F.coalesce("title", F.lit("N/A")).alias("ch_title"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias("ch_" + c)
          for c in ("subscriber_count", "view_count", "video_count")],
    )
    return videos.join(ch, "channel_id", "left").join(top, "video_id", "left")


def _comment_lines() -> Column:
    return F.transform("top_comments", lambda c: F.concat(
        c["number"].cast("string"), F.lit(". "), F.coalesce(c["author"], F.lit("Anonymous")), F.lit(": "), c["text"]
    ))


def video_details(videos: DataFrame, channels: DataFrame, comments: DataFrame) -> DataFrame:
    """The plain layout of a video without transcript: details, comments, channel."""
    joined = _with_channel_and_comments(videos, channels, comments)
    none = F.array().cast("array<string>")
    rule = F.lit("-" * 80)

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    head = F.array(
        F.lit("Video Details:"),
        line("Title", _or_na("title")), line("Channel", _or_na("channel_title")), line("Views", _or_na("view_count")),
        line("Likes", _or_na("like_count")), line("Duration", _or_na("duration")),
        line("Has captions", F.when(F.coalesce("caption", F.lit(False)), "True").otherwise("False")),
        rule,
    )
    talk = F.when(F.size(F.coalesce("top_comments", F.array())) > 0, F.concat(
        F.array(F.lit("Top 5 Comments:")), _comment_lines(), F.array(rule)
    )).otherwise(none)
    channel = F.when(F.col("_channel"), F.array(
        F.lit("Channel Details:"), line("Name", F.col("ch_title")), line("Subscribers", F.col("ch_subscriber_count")),
        line("Total Views", F.col("ch_view_count")), line("Total Videos", F.col("ch_video_count")),
    )).otherwise(none)
    return joined.select("video_id", F.array_join(F.concat(head, talk, channel), "\n").alias("content"))


def assemble_video(
    videos: DataFrame, channels: DataFrame, comments: DataFrame, segments: DataFrame,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Video with channel, top comments and transcript as one attempt row.

    Every side is reduced to one row per key before its left join; a missing
    side leaves its lines out.  Only the transcript's length is needed here, so
    no transcript text is collected.
    """
    joined = _with_channel_and_comments(videos, channels, comments).join(transcript_length(segments), "video_id", "left")
    if summaries is not None:
        joined = joined.join(summaries.select("video_id", F.col("summary").alias("_summary")), "video_id", "left")
    else:
        joined = joined.withColumn("_summary", F.lit(None).cast("string"))

    none = F.array().cast("array<string>")
    head = F.array(
        _line("Views", _or_na("view_count")),
        _line("Likes", _or_na("like_count")),
        _line("Duration", _or_na("duration")),
        _line("Has captions", F.when(F.coalesce("caption", F.lit(False)), "True").otherwise("False")),
        F.lit("   "),
        F.lit("---"),
    )
    channel = F.when(F.col("_channel"), F.array(
        F.lit("Channel Details:  "),
        _line("Name", F.col("ch_title")),
        _line("Subscribers", F.col("ch_subscriber_count")),
        _line("Total Views", F.col("ch_view_count")),
        _line("Total Videos", F.col("ch_video_count")),
        F.lit("  "),
        F.lit("---"),
    )).otherwise(none)
    has_text = F.coalesce(F.col("n_chars") > 0, F.lit(False))
    summary = F.when(F.coalesce("_summary", F.lit("")) != "", F.array(F.col("_summary"), F.lit("  "))).otherwise(none)
    transcript = F.when(has_text, F.concat(
        F.array(
            F.concat(F.lit("Full transcript length: "), F.col("n_chars").cast("string"), F.lit(" characters  ")),
            F.lit("  "),
        ),
        summary,
    )).otherwise(F.array(F.lit(V.NO_TRANSCRIPT)))
    talk = F.when(F.size(F.coalesce("top_comments", F.array())) > 0, F.concat(
        F.array(F.lit("Top 5 Comments:")),
        _comment_lines(),
        F.array(F.lit("--")),
    )).otherwise(none)
    return joined.select(
        "video_id", "channel_id",
        F.lit("youtube").alias("type"),
        F.array_join(F.concat(head, channel, transcript, talk), "\n").alias("content"),
        F.lit(V.METHOD_VIDEO).alias("extraction_method"),
        F.coalesce("n_chars", F.lit(0)).alias("transcript_chars"),
        F.size(F.coalesce("top_comments", F.array())).alias("n_comments"),
    )


def playlist_block(playlists: DataFrame, items: DataFrame, n: int = V.PLAYLIST_PREVIEW) -> DataFrame:
    """Playlist with its first videos as one attempt row."""
    shown = preview_n(items, n).groupBy("playlist_id").agg(
        F.sort_array(F.collect_list(F.struct("number", "position", "title", "video_id"))).alias("shown")
    )
    joined = playlists.join(shown, "playlist_id", "left")
    none = F.array().cast("array<string>")
    count = F.size(F.coalesce("shown", F.array()))
    total = F.coalesce(F.col("item_count").cast("string"), count.cast("string"))
    head = F.array(
        _line("Playlist", _or_na("title")),
        F.lit("---"),
        _line("Channel", _or_na("channel_title")),
        _line("Total Videos", total),
        _line("Published", F.coalesce("published_at", F.lit(""))),
        F.lit("   "),
        F.lit("---"),
    )
    about = F.when(F.coalesce("description", F.lit("")) != "", F.array(
        F.lit("Description:"), T.playlist_description(F.col("description")), F.lit("---")
    )).otherwise(none)
    link = "https://www.youtube.com/watch?v="
    listed = F.when(count > 0, F.concat(
        F.array(
            F.concat(F.lit("Videos in playlist (showing first "), count.cast("string"), F.lit(" of "), total, F.lit("):")),
            F.lit(""),
        ),
        F.transform("shown", lambda v: F.concat(
            v["position"].cast("string"), F.lit(". ["), v["title"], F.lit("]("),
            F.coalesce(F.concat(F.lit(link), F.nullif(v["video_id"], F.lit(""))), F.lit("N/A")), F.lit(")  ")
        )),
        F.array(F.lit("---")),
    )).otherwise(F.array(F.lit(V.NO_PLAYLIST_VIDEOS)))
    return joined.select(
        "playlist_id", F.lit("youtube_playlist").alias("type"),
        F.array_join(F.concat(head, about, listed), "\n").alias("content"),
        F.lit(V.METHOD_VIDEO).alias("extraction_method"),
    )


def _snippet(c: Column) -> Column:
    return T.truncate(F.coalesce(c, F.lit("")), V.DESCRIPTION_LIMIT)


def video_summary_block() -> Column:
    """Short model-free description of a ``videos`` row."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit('YouTube Video: "'), _or_na("title"), F.lit('"')),
        F.concat(F.lit("Channel: "), _or_na("channel_title")),
        F.concat(F.lit("Views: "), _or_na("view_count"), F.lit(", Likes: "), _or_na("like_count")),
        F.concat(F.lit("Published: "), F.coalesce("published_at", F.lit(""))),
        F.concat(F.lit("Description Snippet: "), _snippet(F.col("description"))),
    )


def playlist_summary_block() -> Column:
    """Short description of a ``playlists`` row; names its first five videos."""
    titles = F.transform(
        F.slice("videos_preview", 1, V.PLAYLIST_SUMMARY_TITLES),
        lambda v: F.concat(F.lit('- "'), v["title"], F.lit('"')),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit('YouTube Playlist: "'), _or_na("title"), F.lit('"')),
        F.concat(F.lit("Channel: "), _or_na("channel_title")),
        F.concat(F.lit("Total Videos: "), _or_na("item_count")),
        F.concat(F.lit("Published: "), F.coalesce("published_at", F.lit(""))),
        F.concat(F.lit("Description Snippet: "), _snippet(F.col("description"))),
        F.concat(F.lit("Video Preview:\n"), F.array_join(titles, "\n")),
    )


def repo_summary_input() -> Column:
    """Text about a ``repos`` row that goes into its prompt."""
    langs = F.when(
        F.size("languages") > 0, F.concat(F.lit("Languages: "), F.array_join("languages", ", "), F.lit("\n\n"))
    ).otherwise("")
    return F.concat(
        F.lit("Title: "), F.col("title"), F.lit("  Description: "), F.col("description"), F.lit("\n\nStatistics:\n"),
        F.lit("- Stars: "), F.col("stars"), F.lit("\n- Forks: "), F.col("forks"), F.lit("\n- Watchers: "), F.col("watching"),
        F.lit("\nLast Commit: "), F.col("commit_message"), F.lit(" ("), F.col("commit_date"), F.lit(")\n"),
        langs, F.lit("README Content:\n"), F.col("readme"),
    )


def repo_block(summary: Column) -> Column:
    """Report text of a ``repos`` row."""
    tech = F.when(F.size("languages") > 0, F.array_join("languages", ", ")).otherwise("Not specified")
    return F.concat(
        F.lit("Title: "), F.col("title"), F.lit("  \n    \n"), summary,
        F.lit("  \n\nTechnologies: "), tech,
        F.lit("  \nForks: "), F.col("forks"), F.lit("  \nStars: "), F.col("stars"),
        F.lit("  \nCommit Activity: "), F.col("commit_count"), F.lit(" commits, last commit on "), F.col("commit_date"),
    )
