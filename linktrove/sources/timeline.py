"""Conversation timelines and post media from nested JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import schemas


def read_timeline(raw: DataFrame, json_col: str = "raw", focal: str = "focal_tweet_id") -> DataFrame:
    """One row per (focal post, entry, post); a row without post or author id is dropped.

    Entries of the first add-entries instruction.  ``conversationthread-``
    entries give one row per item, ``tweet-`` entries give one row.
    """
    parsed = F.from_json(F.col(json_col), schemas.TIMELINE_DDL)
    instructions = parsed["data"]["threaded_conversation_with_injections_v2"]["instructions"]
    adding = F.filter(instructions, lambda i: i["type"] == "TimelineAddEntries")
    entries = F.get(adding, F.lit(0))["entries"]
    rows = raw.select(F.col(focal).alias("focal_tweet_id"), F.posexplode(entries).alias("entry_pos", "entry"))

    def result(node: Column) -> Column:
        inner = node["content"]["itemContent"]["tweet_results"]["result"]
        return F.coalesce(inner, node["item"]["itemContent"]["tweet_results"]["result"])

    entry_id = F.col("entry.entryId")
    empty = F.array().cast(f"array<{schemas._TWEET_RESULT_DDL}>")
    results = (
        F.when(entry_id.startswith("conversationthread-"), F.transform("entry.content.items", result))
        .when(entry_id.startswith("tweet-"), F.array(result(F.col("entry"))))
        .otherwise(empty)
    )
    found = rows.select("focal_tweet_id", "entry_pos", entry_id.alias("entry_id"), F.explode(results).alias("r"))
    return found.select(
        "focal_tweet_id", "entry_pos", "entry_id",
        F.col("r.rest_id").alias("tweet_id"),
        F.col("r.core.user_results.result.rest_id").alias("author_id"),
    ).where(F.col("tweet_id").isNotNull() & F.col("author_id").isNotNull())


def read_tweet_media(raw: DataFrame, json_col: str = "raw", key: str = "tweet_id") -> DataFrame:
    """One row per media entry of a post: extended entities, else plain entities."""
    parsed = F.from_json(F.col(json_col), schemas.TWEET_RESULT_DDL)
    result = parsed["data"]["tweetResult"]["result"]
    rows = raw.select(F.col(key), result.alias("result")).where(
        (F.coalesce(F.col("result.__typename"), F.lit("")) != "TweetUnavailable")
        & F.col("result.legacy").isNotNull()
    )
    media = F.coalesce("result.legacy.extended_entities.media", "result.legacy.entities.media")
    return rows.select(key, F.posexplode(media).alias("index", "media")).select(
        key, "index", "media.type", "media.media_url_https",
        F.col("media.video_info.variants").alias("variants"),
    )
