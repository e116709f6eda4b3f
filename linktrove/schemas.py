"""Fixed schemas of the tables the jobs read and write.

Every entity has one wide nullable schema; a missing value is a typed NULL and
is only turned into display text (``N/A``, ``Anonymous`` ...) in report
projections.
"""

from pyspark.sql.types import StructType

# Schemas are DDL texts, so that importing this module needs no session.
PROJECTS = ("id BIGINT, name STRING, input_pos BIGINT")

TASKS = (
    "id BIGINT, project_id BIGINT, content STRING, description STRING, "
    "labels ARRAY<STRING>, created_at TIMESTAMP_NTZ, input_pos BIGINT"
)

TASK_URLS = (
    "task_id BIGINT, created_at TIMESTAMP_NTZ, pos INT, url STRING, kind STRING, "
    "video_id STRING, playlist_id STRING, tweet_id STRING"
)

LEDGER = ("url STRING, task_id BIGINT, processed_at TIMESTAMP_NTZ, success BOOLEAN")

ATTEMPTS = (
    "task_id BIGINT, pos INT, url STRING, type STRING, content STRING, error STRING, "
    "extraction_method STRING, s3_url STRING, downloaded_video_path STRING, "
    "downloaded_markdown_path STRING, downloaded_pdf_path STRING"
)

TWEETS = (
    "tweet_id STRING, user_name STRING, user_handle STRING, created_at STRING, "
    "timestamp BIGINT, text STRING, urls ARRAY<STRING>, error STRING"
)

MEDIA_ITEMS = ("tweet_id STRING, type STRING, index INT, url STRING, extension STRING")

VIDEOS = (
    "video_id STRING, title STRING, description STRING, published_at STRING, "
    "channel_id STRING, channel_title STRING, tags ARRAY<STRING>, category_id STRING, "
    "thumbnails MAP<STRING, STRUCT<url: STRING, width: INT, height: INT>>, "
    "view_count BIGINT, like_count BIGINT, comment_count BIGINT, duration STRING, "
    "definition STRING, caption BOOLEAN"
)

COMMENTS = (
    "video_id STRING, position INT, author STRING, text STRING, published_at STRING, "
    "like_count BIGINT, author_channel_id STRING"
)

CHANNELS = (
    "channel_id STRING, title STRING, description STRING, custom_url STRING, "
    "published_at STRING, thumbnails MAP<STRING, STRUCT<url: STRING, width: INT, height: INT>>, "
    "country STRING, view_count BIGINT, subscriber_count BIGINT, video_count BIGINT, "
    "banner_image STRING, keywords STRING"
)

TRANSCRIPT_SEGMENTS = ("video_id STRING, seq BIGINT, text STRING")

TRANSCRIPT_LANGUAGES = (
    "video_id STRING, language_code STRING, language_name STRING, is_auto_generated BOOLEAN"
)

TIMELINE_ENTRIES = (
    "focal_tweet_id STRING, entry_pos INT, entry_id STRING, tweet_id STRING, author_id STRING"
)

LOG_LINES = ("ts TIMESTAMP_NTZ, logger STRING, level STRING, message STRING")

PAGES = ("page_id BIGINT, url STRING, html STRING")

# --- raw JSON shapes (source edge only) ----------------------------------------
RAW_TASK_DDL = (
    "STRUCT<id: STRING, project_id: STRING, content: STRING, description: STRING, "
    "labels: ARRAY<STRING>, created_at: STRING>"
)

_TWEET_RESULT_DDL = (
    "STRUCT<rest_id: STRING, core: STRUCT<user_results: STRUCT<result: STRUCT<rest_id: STRING>>>>"
)
_ITEM_CONTENT_DDL = f"STRUCT<tweet_results: STRUCT<result: {_TWEET_RESULT_DDL}>>"
TIMELINE_DDL = (
    "STRUCT<data: STRUCT<threaded_conversation_with_injections_v2: STRUCT<instructions: "
    "ARRAY<STRUCT<type: STRING, entries: ARRAY<STRUCT<entryId: STRING, content: "
    f"STRUCT<itemContent: {_ITEM_CONTENT_DDL}, items: ARRAY<STRUCT<"
    f"content: STRUCT<itemContent: {_ITEM_CONTENT_DDL}>, "
    f"item: STRUCT<itemContent: {_ITEM_CONTENT_DDL}>>>>, "
    f"item: STRUCT<itemContent: {_ITEM_CONTENT_DDL}>>>>>>>>"
)

MEDIA_DDL = (
    "ARRAY<STRUCT<type: STRING, media_url_https: STRING, video_info: STRUCT<variants: "
    "ARRAY<STRUCT<content_type: STRING, bitrate: BIGINT, url: STRING>>>>>"
)
TWEET_RESULT_DDL = (
    "STRUCT<data: STRUCT<tweetResult: STRUCT<result: STRUCT<__typename: STRING, "
    f"legacy: STRUCT<extended_entities: STRUCT<media: {MEDIA_DDL}>, "
    f"entities: STRUCT<media: {MEDIA_DDL}>>>>>>"
)

_THUMBS = "MAP<STRING, STRUCT<url: STRING, width: INT, height: INT>>"
VIDEO_ITEM_DDL = (
    "STRUCT<snippet: STRUCT<title: STRING, description: STRING, publishedAt: STRING, "
    "channelId: STRING, channelTitle: STRING, tags: ARRAY<STRING>, categoryId: STRING, "
    f"thumbnails: {_THUMBS}>, "
    "statistics: STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>, "
    "contentDetails: STRUCT<duration: STRING, definition: STRING, caption: STRING>>"
)
COMMENT_ITEM_DDL = (
    "STRUCT<snippet: STRUCT<topLevelComment: STRUCT<snippet: STRUCT<authorDisplayName: STRING, "
    "textDisplay: STRING, publishedAt: STRING, likeCount: BIGINT, "
    "authorChannelId: STRUCT<value: STRING>>>>>"
)
CHANNEL_ITEM_DDL = (
    "STRUCT<snippet: STRUCT<title: STRING, description: STRING, customUrl: STRING, "
    f"publishedAt: STRING, thumbnails: {_THUMBS}, country: STRING>, "
    "statistics: STRUCT<viewCount: STRING, subscriberCount: STRING, videoCount: STRING>, "
    "brandingSettings: STRUCT<channel: STRUCT<bannerImageUrl: STRING, keywords: STRING>>>"
)
LANGUAGE_ITEM_DDL = "STRUCT<language_code: STRING, language: STRING, is_generated: BOOLEAN>"
PLAYLIST_ITEM_DDL = (
    "STRUCT<snippet: STRUCT<title: STRING, position: INT, "
    "resourceId: STRUCT<kind: STRING, videoId: STRING>>>"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
