"""Post media, thread counts, stream choice and assembled post rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import text as T
from linktrove.operators.grouping import PART_ROWS, first_per_key, ordered_parts


def _best_mp4(variants: Column) -> Column:
    """URL of the mp4 variant of highest bitrate; the first one wins a tie."""
    mp4 = F.filter(variants, lambda v: v["content_type"] == "video/mp4")
    ranked = F.transform(
        mp4, lambda v, i: F.struct(F.coalesce(v["bitrate"], F.lit(0)).alias("b"), (-i).alias("i"), v["url"].alias("url"))
    )
    return F.array_max(ranked)["url"]


def media_items(media_raw: DataFrame, gif_mode: str = "first", key: str = "tweet_id") -> DataFrame:
    """Best URL and extension per media row, inside the row (no shuffle).

    ``gif_mode``: ``first`` takes an animation's first variant, ``best`` its
    best mp4.  Rows without URL are dropped; ``index`` keeps the old position.
    """
    gif = F.get("variants", F.lit(0))["url"] if gif_mode == "first" else _best_mp4(F.col("variants"))
    picked = (
        F.when(F.col("type") == "photo", F.col("media_url_https"))
        .when(F.col("type") == "video", _best_mp4(F.col("variants")))
        .when(F.col("type") == "animated_gif", gif)
    )
    rows = media_raw.select(key, "type", "index", F.nullif(picked, F.lit("")).alias("full_url"))
    return rows.where(F.col("full_url").isNotNull()).select(
        key, "type", "index",
        T.drop_query(F.col("full_url")).alias("url"),
        T.media_extension(F.col("full_url"), F.col("type")).alias("extension"),
    )


def best_variant(variants: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The same choice where variants are rows: ``content_type``, ``bitrate``.

    ``order`` is the original order, used on equal bitrates.
    """
    mp4 = variants.where(F.col("content_type") == "video/mp4")
    return first_per_key(mp4, key, [F.coalesce("bitrate", F.lit(0)).desc(), *order])


def thread_count(entries: DataFrame, focal_ids: DataFrame | None = None) -> DataFrame:
    """Distinct posts by the author of the focal post; 0 when that author is unknown.

    Where rows name their entry, the author is that of the entry ``tweet-<focal post>``.
    One pass: rows are reduced to distinct (focal, author, post), counted per
    author, and the focal author's count is picked, so that no raw row is
    joined to itself.
    """
    is_focal = F.col("tweet_id") == F.col("focal_tweet_id")
    if "entry_id" in entries.columns:  # a post quoted elsewhere in the conversation does not name the author
        is_focal = F.col("entry_id") == F.concat(F.lit("tweet-"), F.col("focal_tweet_id"))
    per_author = entries.groupBy("focal_tweet_id", "author_id").agg(
        F.count_distinct("tweet_id").alias("n"), F.max(is_focal).alias("is_focal")
    )
    counts = per_author.groupBy("focal_tweet_id").agg(
        F.coalesce(F.max(F.when(F.col("is_focal"), F.col("n"))), F.lit(0)).alias("n_tweets")
    )
    if focal_ids is None:
        return counts
    return focal_ids.join(counts, "focal_tweet_id", "left").withColumn("n_tweets", F.coalesce("n_tweets", F.lit(0)))


def media_type_counts(items: DataFrame, key: str = "tweet_id", index: str = "index", kind: str = "type") -> DataFrame:
    """Count per type and the position it was first seen at."""
    return items.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first_seen"))


def best_stream(streams: DataFrame, key: str = "video_id") -> DataFrame:
    """Progressive mp4 of highest resolution, else any mp4; else an error row.

    ``streams``: key, pos, extension, progressive, resolution (number).  One
    aggregate, combined before the shuffle.
    """
    usable = (F.col("extension") == "mp4") & F.col("resolution").isNotNull()
    order = F.struct((~F.col("progressive")).alias("a"), (-F.col("resolution")).alias("b"), F.col("pos").alias("c"))
    best = F.min_by(F.struct("pos", "progressive", "resolution"), F.when(usable, order))
    found = streams.groupBy(key).agg(best.alias("s"), F.count_if(usable).alias("n"))
    stream = F.when(F.col("n") > 0, F.col("s"))
    return found.select(
        key, stream["pos"].alias("pos"), stream["progressive"].alias("progressive"),
        stream["resolution"].alias("resolution"),
        F.when(F.col("n") == 0, "no downloadable stream").alias("error"),
    )


def tweet_block(handle: Column, name: Column, tweet: Column, posted: Column, text: Column, urls: Column) -> Column:
    """Text block of a post."""
    listed = F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.concat(F.lit(" - "), u))
    return F.array_join(
        F.concat(
            F.array(
                F.concat(F.lit("User: @"), F.coalesce(handle, F.lit("unknown")), F.lit(" ("), F.coalesce(name, F.lit("")), F.lit(")  ")),
                F.concat(F.lit("Tweet ID: "), tweet, F.lit("  ")),
                F.coalesce(F.concat(F.lit("Posted on: "), posted, F.lit("  ")), F.lit("Posted on: Unknown")),
                F.lit(""),
                F.lit("---"),
                F.coalesce(text, F.lit(V.NO_TWEET_TEXT)),
            ),
            F.when(F.size(listed) > 0, F.concat(F.array(F.lit("URLs in tweet:")), listed)).otherwise(
                F.array().cast("array<string>")
            ),
        ),
        "\n",
    )


def tweet_report(handle: Column, name: Column, tweet: Column, posted: Column, text: Column, urls: Column) -> Column:
    """Stand-alone report of one post."""
    rule = F.lit("-" * 80)
    listed = F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.concat(F.lit("  - "), u))
    return F.array_join(
        F.concat(
            F.array(
                F.lit("TWEET DOWNLOAD REPORT"),
                F.lit("=" * 56),
                F.concat(F.lit("User: @"), F.coalesce(handle, F.lit("")), F.lit(" ("), F.coalesce(name, F.lit("")), F.lit(")")),
                F.concat(F.lit("Tweet ID: "), tweet),
                F.concat(F.lit("Posted on: "), F.coalesce(posted, F.lit("Unknown"))),
                rule,
                F.lit("CONTENT: "),
                F.coalesce(text, F.lit("")),
                rule,
            ),
            F.when(F.size(listed) > 0, F.concat(F.array(F.lit("URLs in tweet:")), listed, F.array(rule))).otherwise(
                F.array().cast("array<string>")
            ),
        ),
        "\n",
    )


def artifact_note(n_files: Column, type_lines: Column, s3_urls: Column, saved: bool, uploaded: bool) -> Column:
    """Lines that tell what was stored for a post."""
    verb = "Downloaded and uploaded to S3" if saved and uploaded else "Downloaded" if saved else "Uploaded to S3"
    head = F.concat(F.lit(f"{verb} "), n_files.cast("string"), F.lit(" media files:"))
    none = F.array().cast("array<string>")
    places = none
    if uploaded:
        places = F.when(
            F.size(s3_urls) > 0,
            F.concat(F.array(F.lit("\nS3 Locations:")), F.transform(s3_urls, lambda u: F.concat(F.lit("- "), u))),
        ).otherwise(none)
    return F.array_join(F.concat(F.array(head), type_lines, places), "\n")


def assemble_tweet(
    tweets: DataFrame, items: DataFrame, artifacts: DataFrame, saved: bool = False, uploaded: bool = True,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Post with its media and stored artifacts as one attempt row.

    ``artifacts``: tweet_id, index, type, s3_url.  Lists are cut into parts of
    ``part_rows`` rows; a usual post has one part (0), an oversized one has more
    rows, whose lists continue in order.  Content stands in part 0; later parts
    carry on its list of locations, so that the contents joined by newline are
    the whole text.
    """
    media_parts = ordered_parts(items.where(F.col("url").isNotNull()), ["tweet_id"], "index", F.col("url"), "media_urls", part_rows)
    s3_parts = ordered_parts(artifacts.where(F.col("s3_url").isNotNull()), ["tweet_id"], "index", F.col("s3_url"), "s3_urls", part_rows)
    parts = media_parts.join(s3_parts, ["tweet_id", "part"], "full_outer")

    n_media = items.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n_media"))
    line = F.concat(F.lit("- "), T.capitalize(F.col("type")), F.lit(": "), F.col("n").cast("string"))
    stored = (
        media_type_counts(artifacts.withColumn("type", F.coalesce("type", F.lit("unknown"))))
        .groupBy("tweet_id")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col("first_seen"), line.alias("line")))).alias("_types"),
            F.sum("n").alias("n_files"),
        )
        .withColumn("type_lines", F.transform("_types", lambda r: r["line"]))
        .drop("_types")
    )
    base = tweets.join(n_media, "tweet_id", "left").join(stored, "tweet_id", "left").join(parts, "tweet_id", "left")

    none = F.array().cast("array<string>")
    first = F.coalesce(F.col("part"), F.lit(0)) == 0
    posted = T.utc_display(T.from_utc(F.timestamp_seconds("timestamp")))
    block = tweet_block(F.col("user_handle"), F.col("user_name"), F.col("tweet_id"), posted, F.col("text"), F.col("urls"))
    n_found = F.coalesce("n_media", F.lit(0))
    found = F.when(n_found > 0, F.concat(F.lit("\n\nMedia: "), n_found.cast("string"), F.lit(" items detected"))).otherwise("")
    if saved or uploaded:
        note = F.concat(
            F.lit("\n\n"),
            F.when(n_found == 0, V.NOTE_NO_MEDIA)
            .when(F.col("n_files").isNull(), V.NOTE_NOTHING_STORED)
            .otherwise(artifact_note(F.col("n_files"), F.col("type_lines"), F.coalesce("s3_urls", none), saved, uploaded)),
        )
        more = F.nullif(F.array_join(F.transform(F.coalesce("s3_urls", none), lambda u: F.concat(F.lit("- "), u)), "\n"), F.lit(""))
        more = more if uploaded else F.lit(None).cast("string")
    else:
        note, more = F.lit(""), F.lit(None).cast("string")
    return base.select(
        "tweet_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.lit("twitter").alias("type"),
        F.when(first, F.concat(block, found, note)).otherwise(more).alias("content"),
        F.nullif(F.concat_ws("; ", F.col("error")), F.lit("")).alias("error"),
        F.lit(V.METHOD_TWEET).alias("extraction_method"),
        F.coalesce("media_urls", none).alias("media_urls"),
        F.coalesce("s3_urls", none).alias("s3_urls"),
        n_found.alias("n_media"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
    )


def join_errors(*errors: Column) -> Column:
    """Errors of the steps of one attempt as one text; NULL when there is none."""
    return F.nullif(F.concat_ws("; ", *[F.nullif(e, F.lit("")) for e in errors]), F.lit(""))
