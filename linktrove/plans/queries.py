"""Registered queries: every operator over the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import text as T
from linktrove.functions import urls as U
from linktrove.operators import aliases, inference, ledger, logs, media, outcomes, pages, report, summary, tasks, video
from linktrove.operators.grouping import range_numbering, stable_numbering
from linktrove.plans import views as D
from linktrove.plans.capture_run import CaptureRun
from linktrove.sources import ledger as store
from linktrove.sources import objects
from linktrove.sources import sinks, timeline
from linktrove.sources.scratch import materialize, new_folder
from linktrove.sources.tasks import concat_all, flatten_pages
from linktrove.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FULL_LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# --- URLs ------------------------------------------------------------------------------
@query
def link_census(spark, sf):
    """New links by kind and host: extract, drop what the ledger knows, route, count."""
    fresh = ledger.unseen_urls(D.task_urls(spark, sf), D.ledger(spark, sf))
    return fresh.groupBy("kind", U.host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_links"), F.count_distinct("url").alias("n_urls")
    )


@query
def extract_urls(spark, sf):
    return D.task_urls(spark, sf).select("task_id", "pos", "url")


@query
def clean_url(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", U.clean_url(F.col("url")).alias("url"))


@query
def valid_url(spark, sf):
    shapes = F.expr(
        "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'ftp' || url WHEN 2 THEN replace(url, '://', ':') "
        "WHEN 3 THEN upper(url) ELSE 'https:///' || page_id END"
    )
    rows = D.table(spark, sf, "pages").select("page_id", shapes.alias("url"))
    return rows.select("page_id", "url", U.valid_url(F.col("url")).cast("int").alias("valid"))


@query
def url_kind(spark, sf):
    return D.task_urls(spark, sf).select(
        "task_id", "pos", "kind", "video_id", "playlist_id", "tweet_id",
        U.collection_kind(F.col("url")).alias("collection"),
    )


@query
def ordered_union(spark, sf):
    """Distinct union of two URL lists, first-seen order, and their plain concatenation."""
    caps = D.capture_tasks(spark, sf)
    a, b = U.extract_urls(F.col("content")), U.extract_urls(F.col("description"))
    return caps.select(
        F.col("id").alias("task_id"),
        F.array_join(U.ordered_union(b, a, b), " ").alias("union_urls"),
        F.size(F.concat(b, a, b)).alias("n_all"),
    )


@query
def concat_task_lists(spark, sf):
    """Task lists of both projects put one after the other."""
    caps = D.capture_tasks(spark, sf).select("id", "project_id", "content")
    both = concat_all(caps, caps.select("id", "project_id"))
    return both.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("content").alias("n_with_content"))


# --- ledger ------------------------------------------------------------------------------
@query
def unseen_urls(spark, sf):
    return ledger.unseen_urls(D.task_urls(spark, sf), D.ledger(spark, sf)).select("task_id", "pos", "url")


def _stored_rows(spark, sf):
    """Attempt rows written once: the gates read them several times."""
    return materialize(D.attempt_rows(spark, sf), "attempt_rows")


@query
def attempt_gate(spark, sf):
    gated = ledger.attempt_gate(_stored_rows(spark, sf), D.ledger(spark, sf))
    return gated.select("task_id", "pos", "url", F.col("ledger_skip").cast("int").alias("ledger_skip"))


@query
def video_dedup(spark, sf):
    rows = ledger.video_dedup(ledger.unseen_urls(D.task_urls(spark, sf), D.ledger(spark, sf)))
    return rows.select("task_id", "pos", "url", "video_id", F.col("duplicate").cast("int").alias("duplicate"))


@query
def gate_rows(spark, sf):
    rows = ledger.gate_rows(_stored_rows(spark, sf), D.ledger(spark, sf))
    return rows.select("task_id", "pos", "url", "action")


@query
def gate_with_aliases(spark, sf):
    rows = aliases.gate_with_aliases(_stored_rows(spark, sf), D.ledger(spark, sf))
    return rows.select("task_id", "pos", "url", "action")


def _updates(spark, sf):
    return D.attempt_rows(spark, sf).select(
        "url", "task_id", F.col("created_at").alias("processed_at"), "success", "created_at", "pos"
    )


@query
def ledger_upsert(spark, sf):
    merged = ledger.ledger_upsert(D.ledger(spark, sf), _updates(spark, sf), ledger.ORDER)
    return merged.withColumn("success", F.col("success").cast("int"))


@query
def ledger_store(spark, sf):
    """The same through the stored change log: base, changes, snapshot, read of the URLs that are asked for."""
    root = new_folder(spark, "ledger")
    store.write_changes(D.ledger(spark, sf), root, 0)
    store.write_changes(ledger.latest_updates(_updates(spark, sf), ledger.ORDER), root, store.next_version(spark, root))
    store.compact_ledger(spark, root)
    asked = D.ledger(spark, sf).select("url").unionByName(_updates(spark, sf).select("url"))
    return store.read_ledger(spark, root, urls=asked).withColumn("success", F.col("success").cast("int"))


@query
def ledger_stats(spark, sf):
    return ledger.ledger_stats(ledger.ledger_upsert(D.ledger(spark, sf), _updates(spark, sf), ledger.ORDER))


# --- tasks ---------------------------------------------------------------------------------
@query
def flatten_task_pages(spark, sf):
    """Pages of four shapes: object with results, list, single item, list of mixed members."""
    item = "named_struct('id', CAST(i AS STRING), 'project_id', CAST(conv_id AS STRING), 'content', line, 'labels', array(role))"
    lines = f"transform(split(text, '\\n'), (line, i) -> {item})"
    raw = D.table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS page_no",
        f"CASE turn % 4 WHEN 0 THEN to_json(named_struct('results', {lines})) "
        f"WHEN 1 THEN to_json({lines}) "
        f"WHEN 2 THEN to_json(named_struct('id', '0', 'project_id', CAST(conv_id AS STRING), 'content', text, 'labels', array(role))) "
        f"ELSE '[' || to_json(named_struct('results', {lines})) || ',' || to_json({lines}) || ']' END AS raw",
    )
    return flatten_pages(raw).select(
        "page_no", "item_no", "item.id", "item.project_id", "item.content", F.array_join("item.labels", ",").alias("labels")
    )


@query
def capture_scope(spark, sf):
    return tasks.capture_scope(D.capture_tasks(spark, sf), D.projects(spark, sf)).select("id", "project_id", "content")


@query
def oldest_tasks(spark, sf):
    chosen = tasks.oldest_tasks(D.capture_tasks(spark, sf), 100)
    return chosen.select("id", "created_at", "content")


@query
def label_filter(spark, sf):
    return tasks.label_filter(D.capture_tasks(spark, sf)).select("id", "content")


@query
def label_append(spark, sf):
    rows = tasks.label_append(D.capture_tasks(spark, sf))
    return rows.select("id", F.array_join("labels", ",").alias("labels"), F.size("labels").alias("n_labels"))


@query
def notebook_gate(spark, sf):
    rows = tasks.notebook_gate(D.capture_tasks(spark, sf))
    return rows.select("id", F.col("has_notebook").cast("int").alias("has_notebook"))


# --- outcomes ---------------------------------------------------------------------------------
@query
def error_class(spark, sf):
    rows = D.attempts(D.task_urls(spark, sf))
    return rows.select(
        "task_id", "pos", outcomes.error_class(F.col("content"), F.col("error")).alias("error_class"),
        outcomes.hidden_summary_error(F.col("content")).cast("int").alias("hidden_error"),
    )


def _run(spark, sf) -> CaptureRun:
    return CaptureRun(
        D.capture_tasks(spark, sf), D.projects(spark, sf), D.ledger(spark, sf),
        D.attempts(D.task_urls(spark, sf)), run_at="2024-06-01 00:00:00",
    )


@query
def task_outcome(spark, sf):
    return _run(spark, sf).outcomes.select(
        "task_id", "status", "counted_as", "n_new", "n_skip",
        F.array_join("labels", ",").alias("labels"), F.col("in_report").cast("int").alias("in_report"),
    )


@query
def run_summary(spark, sf):
    return _run(spark, sf).summary


@query
def task_report(spark, sf):
    return _run(spark, sf).report


@query
def run_ledger_changes(spark, sf):
    return _run(spark, sf).ledger_changes.select("url", "task_id", F.col("success").cast("int").alias("success"))


@query
def report_filter(spark, sf):
    """Tasks fit for the report, from nested attempt lists (bounded by the task's text)."""
    caps = D.capture_tasks(spark, sf)
    urls = tasks.task_url_array(F.col("content"), F.col("description"))
    nested = caps.select(F.col("id").alias("task_id"), urls.alias("urls")).select(
        "task_id",
        F.expr(
            "transform(urls, url -> named_struct('url', url, 'content', "
            f"{D.ATTEMPT_CONTENT}, 'error', {D.ATTEMPT_ERROR}))"
        ).alias("processed_urls"),
    )
    return report.report_filter(nested).select("task_id", F.size("processed_urls").alias("n_attempts"))


@query
def reportable_tasks(spark, sf):
    return report.reportable_tasks(D.attempts(D.task_urls(spark, sf)))


@query
def batch_summary(spark, sf):
    rows = D.table(spark, sf, "events").select("user_id", (F.col("event_type") != "error").alias("success"))
    return outcomes.batch_summary(rows, "user_id").withColumn("success", F.col("success").cast("int"))


@query
def batch_summary_all(spark, sf):
    """Every customer is a batch; those without events are batches without results."""
    rows = D.table(spark, sf, "events").select(F.col("user_id").alias("batch"), (F.col("event_type") != "error").alias("success"))
    batches = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("batch"))
    return outcomes.batch_summary(rows, "batch", batches=batches).withColumn("success", F.col("success").cast("int"))


@query
def retry_table(spark, sf):
    log = D.table(spark, sf, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("attempt"),
        (F.col("event_type") == "purchase").alias("success"),
        F.expr("CASE WHEN event_type <> 'purchase' THEN 'failed: ' || event_type END").alias("error"),
        F.expr("CASE event_type WHEN 'error' THEN 'language_unavailable' WHEN 'purchase' THEN NULL ELSE 'other_error' END").alias("reason"),
    )
    state = outcomes.retry_table(log, ["user_id", "day"])
    return state.withColumn("success", F.col("success").cast("int")).withColumn("retry", F.col("retry").cast("int"))


# --- pages ---------------------------------------------------------------------------------------
@query
def page_text(spark, sf):
    return pages.page_text(D.table(spark, sf, "pages")).select("page_id", "text")


@query
def page_markdown(spark, sf):
    return pages.page_markdown(D.table(spark, sf, "pages")).select("page_id", "markdown")


@query
def page_fields(spark, sf):
    rows = pages.page_fields(D.table(spark, sf, "pages"))
    return rows.select(
        "page_id", "title", "language", F.array_join("headings", "|").alias("headings"), "n_links", "n_images", "n_paragraphs"
    )


@query
def page_links(spark, sf):
    return pages.page_links(D.table(spark, sf, "pages")).select("page_id", "pos", "href", "text", "url")


@query
def tweet_links(spark, sf):
    """Page anchors taken as post links: some tags, mentions and shortened links."""
    links = pages.page_links(D.table(spark, sf, "pages")).select(
        "page_id", "pos",
        F.expr(
            "CASE pos % 5 WHEN 0 THEN '/hashtag' || href WHEN 1 THEN '/@' || text "
            "WHEN 2 THEN 'https://t.co/' || pos ELSE href END"
        ).alias("href"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN 'https://full.example.com' || href END").alias("title"),
    )
    return pages.tweet_links(links).select("page_id", "pos", "link")


@query
def content_gate(spark, sf):
    docs = D.table(spark, sf, "documents")
    return docs.select("doc_id", T.content_gate(F.col("text")).cast("int").alias("usable"))


@query
def truncate_text(spark, sf):
    docs = D.table(spark, sf, "documents")
    cut = T.page_prompt_text(F.col("text"))
    return docs.select(
        "doc_id", F.md5(cut).alias("page_md5"), F.length(T.transcript_prompt_text(F.col("text"))).alias("transcript_chars"),
        T.comment_text(F.col("text")).alias("comment"), T.playlist_description(F.col("text")).alias("description"),
    )


@query
def squeeze_text(spark, sf):
    loose = F.expr(r"'  ' || replace(replace(text, '. ', '.   '), '\n', ' \n\n\n\n') || ' \n'")
    docs = D.table(spark, sf, "documents").select("doc_id", loose.alias("text"))
    return docs.select(
        "doc_id", T.squeeze_text(F.col("text")).alias("text"), T.squeeze_pdf_text(F.col("text")).alias("pdf_text")
    )


@query
def extractive_summary(spark, sf):
    return summary.extractive_summary(D.table(spark, sf, "documents"))


#: A post page with elements nested in its elements.
POST_HTML = """concat('<article><div class="top"><div data-testid="User-Name" class="a"><div><div dir="auto"><span><span>', role, ' &amp; Co</span> ', conv_id,
  '</span></div></div><div dir="ltr"><span>@', role, conv_id, '</span></div></div><div dir="ltr">outside</div></div>',
  '<div lang="en" data-testid="tweetText"><span>Turn ', turn, '</span><div><span>not direct</span></div><span>of <b>', conv_id, '</b><br> &lt;all&gt;</span>',
  '<a href="/hashtag/x">x</a><a href="https://t.co/', turn, '" title="https://full.example.com/', conv_id, '?a=1&amp;b=2">short</a><a href=''https://e.example.com''>e</a></div>',
  '<div><span>after</span></div>', CASE WHEN turn % 2 = 0 THEN concat('<time datetime="2024-03-0', turn % 8 + 1, 'T10:00:00.000Z">then</time>') ELSE '' END,
  '<div data-testid="tweetText"><span>second ', turn, '</span></article>')"""


@query
def post_fields(spark, sf):
    posts = D.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS page_id", "'https://x.com/p' AS url", f"{POST_HTML} AS html")
    return pages.post_fields(posts).select(
        "page_id", "user_name", "user_handle", "text", F.array_join("urls", " ").alias("urls"), "created_at", "timestamp")


@query
def fallback_enrich(spark, sf):
    failed = D.table(spark, sf, "pages").select(
        "page_id", "url", F.expr("page_id % 2 = 0").alias("timed_out"), F.lit("Page load timeout").alias("error")
    )
    return pages.fallback_enrich(failed, D.search_index(spark, sf)).select(
        "page_id", "content", "error", "extraction_method"
    )


@query
def page_attempts(spark, sf):
    loaded = D.table(spark, sf, "pages").withColumn("timed_out", F.expr("page_id % 6 = 0"))
    return pages.page_attempts(loaded, D.search_index(spark, sf)).select(
        "page_id", "type", "content", "error", "extraction_method"
    )


def _texts(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", "text", F.expr("CASE doc_id % 4 WHEN 0 THEN 'webpage' WHEN 1 THEN 'pdf' WHEN 2 THEN 'github' ELSE 'youtube' END").alias("kind")
    )


@query
def build_prompt(spark, sf):
    return inference.build_prompt(_texts(spark, sf)).select("doc_id", "kind", F.md5("prompt").alias("prompt_md5"))


@query
def summarize_with(spark, sf):
    def length_model():
        """Stands in for a model: answers with the length of the prompt, refuses some."""
        def answer(prompts: list[str]) -> list[str]:
            if any(len(p) % 50 == 0 for p in prompts):
                raise RuntimeError("refused")
            return [f"prompt of {len(p)} characters" for p in prompts]

        return answer

    prompts = inference.build_prompt(_texts(spark, sf)).select("doc_id", "prompt")
    return inference.summarize_with(prompts, length_model, max_attempts=2).select("doc_id", "summary")


@query
def summarize_tree(spark, sf):
    """Whole texts in overlapping chunks of 3000 characters, answers joined four at a time."""
    def length_model():
        return lambda prompts: [f"answer to {len(p)} characters" for p in prompts]

    odd = "CASE doc_id % 11 WHEN 5 THEN '' WHEN 6 THEN '[Error: no text]' ELSE text END"
    return inference.summarize_tree(_texts(spark, sf).withColumn("text", F.expr(odd)), length_model, chunk_chars=3000, overlap=100, fan_in=4)


# --- media and threads --------------------------------------------------------------------------------
@query
def read_timeline(spark, sf):
    """One timeline per conversation row: the focal entry, then a thread entry with an item per line."""
    def content(tweet, author):
        return (
            f"named_struct('itemContent', named_struct('tweet_results', named_struct('result', named_struct("
            f"'rest_id', {tweet}, 'core', named_struct('user_results', named_struct('result', named_struct('rest_id', {author})))))))"
        )

    focal = "CAST(conv_id * 1000 + turn AS STRING)"
    items = (
        "transform(split(text, '\\n'), (line, i) -> named_struct('item', "
        + content(f"{focal} || '.' || i", "CASE WHEN i % 2 = 0 THEN role ELSE 'other' END") + "))"
    )
    entries = (
        f"'[{{\"entryId\":\"tweet-' || {focal} || '\",\"content\":' || to_json({content(focal, 'role')}) || "
        f"'}},{{\"entryId\":\"conversationthread-1\",\"content\":{{\"items\":' || to_json({items}) || '}}}}]'"
    )
    raw = D.table(spark, sf, "conversations").selectExpr(
        f"{focal} AS focal_tweet_id",
        "'{\"data\":{\"threaded_conversation_with_injections_v2\":{\"instructions\":[{\"type\":\"TimelineClearCache\"},"
        f"{{\"type\":\"TimelineAddEntries\",\"entries\":' || {entries} || '}}]}}}}}}' AS raw",
    )
    return timeline.read_timeline(raw)


@query
def thread_count_json(spark, sf):
    """Thread length straight from the timelines."""
    return media.thread_count(read_timeline(spark, sf))


@query
def thread_count(spark, sf):
    entries = D.table(spark, sf, "conversations").selectExpr(
        "conv_id || '-0' AS focal_tweet_id", "conv_id || '-' || turn AS tweet_id", "role AS author_id"
    )
    return media.thread_count(entries)


@query
def tweet_media(spark, sf):
    """Media JSON per part: a photo, a video with three variants, an animation; some unavailable."""
    variants = (
        "array(named_struct('content_type', 'application/x-mpegURL', 'bitrate', 9999999, 'url', 'https://v.example.com/' || p_partkey || '.m3u8'), "
        "named_struct('content_type', 'video/mp4', 'bitrate', p_size % 7, 'url', 'https://v.example.com/' || p_partkey || '/low.mp4?tag=10'), "
        "named_struct('content_type', 'video/mp4', 'bitrate', p_size % 5, 'url', 'https://v.example.com/' || p_partkey || '/high.MP4'))"
    )
    media_list = (
        "array(named_struct('type', 'photo', 'media_url_https', 'https://i.example.com/' || p_partkey || '.png?name=large', 'video_info', NULL), "
        f"named_struct('type', 'video', 'media_url_https', NULL, 'video_info', named_struct('variants', {variants})), "
        f"named_struct('type', 'animated_gif', 'media_url_https', NULL, 'video_info', named_struct('variants', {variants})))"
    )
    raw = D.table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS tweet_id",
        "to_json(named_struct('data', named_struct('tweetResult', named_struct('result', named_struct("
        "'__typename', CASE WHEN p_size % 10 = 0 THEN 'TweetUnavailable' ELSE 'Tweet' END, 'legacy', "
        f"named_struct('extended_entities', named_struct('media', {media_list}))))))) AS raw",
    )
    return media.media_items(timeline.read_tweet_media(raw))


@query
def best_variant(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("int").alias("bitrate"),
        F.expr("CASE WHEN l_returnflag = 'A' THEN 'video/mp4' ELSE 'application/x-mpegURL' END").alias("content_type"),
        *[c for c in FULL_LINE_ORDER if c != "l_quantity"],
    )
    order = [F.col(c) for c in FULL_LINE_ORDER if c != "l_quantity"]
    return media.best_variant(rows, ["l_orderkey"], order).select("l_orderkey", "bitrate", "l_linenumber", "l_partkey", "l_suppkey")


@query
def media_type_counts(spark, sf):
    return media.media_type_counts(D.table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query
def best_stream(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'webm' ELSE 'mp4' END").alias("extension"),
        (F.col("l_linestatus") == "F").alias("progressive"),
        (F.floor(F.col("l_quantity") / 10) * 144).cast("int").alias("resolution"),
    )
    best = media.best_stream(rows)
    return best.select(
        "video_id", "pos.l_linenumber", "pos.l_partkey", F.col("progressive").cast("int").alias("progressive"), "resolution", "error"
    )


@query
def assemble_tweet(spark, sf):
    tweets = D.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS tweet_id", "'name ' || o_custkey AS user_name", "'user' || o_custkey AS user_handle",
        "CAST(o_orderdate AS STRING) AS created_at",
        "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) AS timestamp",
        "'Order of ' || o_orderpriority AS text",
        "CASE WHEN o_orderkey % 3 = 0 THEN array('/user' || o_custkey, 'https://e.example.com') END AS urls",
        "CASE WHEN o_orderstatus = 'P' THEN 'API data fetch failed' END AS error",
    )
    line = D.table(spark, sf, "lineitem")
    items = line.selectExpr(
        "CAST(l_orderkey AS STRING) AS tweet_id", "'photo' AS type", "l_linenumber - 1 AS index",
        "'https://i.example.com/' || l_partkey || '.jpg' AS url",
    )
    stored = line.where("l_returnflag = 'A'").selectExpr(
        "CAST(l_orderkey AS STRING) AS tweet_id", "CASE l_linestatus WHEN 'O' THEN 'photo' ELSE 'VIDEO' END AS type",
        "l_linenumber - 1 AS index", "'https://b.s3.amazonaws.com/week_01/' || l_partkey || '.jpg' AS s3_url",
    )
    rows = media.assemble_tweet(tweets, items, stored)
    return rows.select(
        "tweet_id", "part", "content", "error", F.array_join("media_urls", " ").alias("media_urls"), "n_media", "n_files"
    )


# --- videos -----------------------------------------------------------------------------------------------
@query
def video_projection(spark, sf):
    raw = D.table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS video_id",
        "to_json(named_struct('snippet', named_struct('title', p_name, 'channelId', p_brand, 'tags', array(p_type, p_brand)), "
        "'statistics', named_struct('viewCount', CASE WHEN p_size % 4 = 0 THEN 'N/A' ELSE CAST(p_size AS STRING) END), "
        "'contentDetails', named_struct('duration', 'PT' || p_size || 'M', 'caption', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END))) AS raw",
    )
    rows = video.video_projection(raw)
    return rows.select(
        "video_id", "title", "description", "channel_id", F.array_join("tags", ",").alias("tags"), "view_count", "like_count",
        "duration", F.col("caption").cast("int").alias("caption"), video.video_summary_block().alias("block"),
    )


@query
def playlist_items(spark, sf):
    raw = D.table(spark, sf, "part").selectExpr(
        "p_brand AS playlist_id",
        "to_json(named_struct('snippet', named_struct('title', CASE WHEN p_size % 9 <> 0 THEN p_name END, 'position', p_size, 'resourceId', "
        "named_struct('kind', CASE WHEN p_partkey % 5 = 0 THEN 'youtube#channel' ELSE 'youtube#video' END, 'videoId', CAST(p_partkey AS STRING))))) AS raw",
    )
    return video.playlist_items(raw)


@query
def comment_projection(spark, sf):
    raw = D.table(spark, sf, "events").selectExpr(
        "CAST(user_id AS STRING) AS video_id", "CAST(event_id AS INT) AS position",
        "to_json(named_struct('snippet', named_struct('topLevelComment', named_struct('snippet', named_struct("
        "'authorDisplayName', CASE WHEN event_id % 3 <> 0 THEN 'user ' || user_id END, 'textDisplay', event_type, "
        "'likeCount', CASE WHEN event_id % 2 = 0 THEN event_id END, 'authorChannelId', named_struct('value', 'c' || user_id)))))) AS raw",
    )
    return video.comment_projection(raw).select("video_id", "position", "author", "text", "like_count", "author_channel_id")


@query
def channel_projection(spark, sf):
    raw = D.table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS channel_id",
        "to_json(named_struct('snippet', named_struct('title', c_name, 'country', CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END), "
        "'statistics', named_struct('subscriberCount', CAST(c_custkey AS STRING), 'viewCount', 'N/A'), "
        "'brandingSettings', named_struct('channel', named_struct('keywords', c_mktsegment)))) AS raw",
    )
    return video.channel_projection(raw).select(
        "channel_id", "title", "description", "country", "subscriber_count", "view_count", "keywords"
    )


@query
def language_projection(spark, sf):
    raw = D.table(spark, sf, "documents").selectExpr(
        "source AS video_id",
        "to_json(named_struct('language_code', lang, 'language', upper(lang), 'is_generated', CASE WHEN n_chars % 3 > 0 THEN n_chars % 3 = 1 END)) AS raw",
    )
    rows = video.language_projection(raw)
    return rows.groupBy("video_id", "language_code", "language_name", F.col("is_auto_generated").cast("int").alias("auto")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def preview_n(spark, sf):
    items = D.table(spark, sf, "part").selectExpr("p_brand AS playlist_id", "p_name AS title", "p_partkey AS position")
    return video.preview_n(items, 60)


@query
def playlist_block(spark, sf):
    part = D.table(spark, sf, "part")
    lists = part.groupBy(F.col("p_brand").alias("playlist_id")).agg(
        F.count(F.lit(1)).alias("item_count"), F.min("p_name").alias("title"), F.max("p_type").alias("channel_title"),
        F.min("p_type").alias("description"),
    ).withColumn("published_at", F.lit("2024-01-01"))
    items = part.selectExpr("p_brand AS playlist_id", "p_name AS title", "p_partkey AS position", "CAST(p_partkey AS STRING) AS video_id")
    return video.playlist_block(lists, items).select("playlist_id", "content")


@query
def top_comments(spark, sf):
    rows = D.table(spark, sf, "events").selectExpr(
        "user_id AS video_id", "ts", "event_id", "repeat(event_type || ' ', CAST(floor(value) AS INT) % 30 + 1) AS text"
    )
    return video.top_comments(rows, order=[F.col("ts"), F.col("event_id")]).select("video_id", "number", "event_id", "text")


@query
def languages_by_name(spark, sf):
    rows = D.table(spark, sf, "documents").selectExpr(
        "source AS video_id", "lang AS language_code",
        "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END AS language_name",
        "n_chars % 2 = 0 AS is_auto_generated",
    )
    listed = video.languages_by_name(rows)
    return listed.select("video_id", F.expr(
        "array_join(transform(languages, l -> l.language_name || '/' || l.language_code || '/' || CAST(l.is_auto_generated AS INT)), ',')"
    ).alias("languages"))


@query
def language_available(spark, sf):
    docs = D.table(spark, sf, "documents")
    requests = docs.selectExpr(
        "doc_id", "source AS video_id",
        "CASE doc_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' ELSE 'it' END AS language",
    )
    known = docs.selectExpr("source AS video_id", "lang AS language_code")
    rows = video.language_available(requests, known)
    return rows.select(
        "doc_id", "video_id", "language", F.col("available").cast("int").alias("available"), "error",
        F.array_join("alternatives", ",").alias("alternatives"),
    )


def _segments(spark, sf):
    return D.table(spark, sf, "conversations").selectExpr("CAST(conv_id AS STRING) AS video_id", "turn AS seq", "text")


@query
def transcript_text(spark, sf):
    return video.transcript_text(_segments(spark, sf))


@query
def transcript_parts(spark, sf):
    """Events of a user as segments at sparse positions, in parts of ten."""
    segments = D.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("video_id"), "event_id", F.col("event_type").alias("text"))
    return video.transcript_text(segments, part_rows=10, seq="event_id")


@query
def assemble_video(spark, sf):
    videos = D.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS video_id", "CAST(o_custkey AS STRING) AS channel_id",
        "CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS view_count", "o_orderkey % 10 AS like_count",
        "o_orderpriority AS duration", "o_orderstatus = 'F' AS caption",
    )
    channels = D.table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS channel_id", "c_name AS title", "c_custkey AS subscriber_count",
        "CAST(NULL AS BIGINT) AS view_count", "CAST(c_nationkey AS BIGINT) AS video_count",
    )
    line = D.table(spark, sf, "lineitem")
    comments = line.select(
        F.col("l_orderkey").cast("string").alias("video_id"),
        F.struct(*FULL_LINE_ORDER).alias("position"),
        F.expr("'supplier ' || l_suppkey").alias("author"),
        F.expr("repeat(l_returnflag, CAST(l_quantity AS INT) * 3)").alias("text"),
    )
    segments = D.table(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS video_id", "event_id AS seq", "event_type AS text")
    return video.assemble_video(videos, channels, comments, segments).select(
        "video_id", "content", "transcript_chars", "n_comments"
    )


@query
def video_details(spark, sf):
    videos = D.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS video_id", "CAST(o_custkey AS STRING) AS channel_id", "o_orderpriority AS title",
        "CAST(NULL AS STRING) AS channel_title", "o_custkey AS view_count", "CAST(NULL AS BIGINT) AS like_count",
        "o_orderstatus AS duration", "o_orderstatus = 'F' AS caption",
    )
    channels = D.table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS channel_id", "c_name AS title", "c_custkey AS subscriber_count",
        "CAST(NULL AS BIGINT) AS view_count", "CAST(c_nationkey AS BIGINT) AS video_count",
    )
    comments = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("video_id"), F.struct(*FULL_LINE_ORDER).alias("position"),
        F.expr("CASE WHEN l_returnflag <> 'R' THEN 'supplier ' || l_suppkey END").alias("author"), F.col("l_linestatus").alias("text"),
    )
    return video.video_details(videos, channels, comments)


# --- artifacts and report ------------------------------------------------------------------------------------
@query
def artifact_names(spark, sf):
    part = D.table(spark, sf, "part")
    raw = F.expr("p_name || '  ' || p_type || '--' || p_brand || '.v' || p_size || '.TXT'")
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    url = F.expr("'https://www.h' || p_size || '.example.com/' || replace(p_name, ' ', '/') || CASE WHEN p_size % 2 = 0 THEN '.pdf' ELSE '/' END")
    return part.select(
        "p_partkey",
        T.clean_filename(raw).alias("file"),
        T.clean_title(F.expr("p_name || ': ' || p_brand || ', ' || p_type || '?'")).alias("title"),
        T.page_filename(url, stamp).alias("page"),
        T.pdf_filename(url, stamp).alias("pdf"),
        T.repo_filename(url, stamp).alias("repo"),
        T.media_filename(T.epoch_seconds(stamp), F.expr("p_brand"), F.expr("CAST(p_partkey AS STRING)"), F.col("p_size"), F.lit("jpg")).alias("media"),
        T.capitalize(F.expr("p_type || '_' || p_name")).alias("word"),
        T.digits_only(raw).alias("digits"),
    )


@query
def repo_fields(spark, sf):
    """Repository pages made from parts; every other page lacks some blocks."""
    html = F.expr(
        "'<strong itemprop=\"name\"><a href=\"/o/r\">' || p_name || '</a></strong>' "
        "|| CASE WHEN p_size % 2 = 0 THEN '<p class=\"f4 mb-3\"> ' || p_type || ' &amp; more </p>' ELSE '' END "
        "|| '<a href=\"/o/r/stargazers\"><span class=\"text-bold\">' || p_size || 'k</span> stars</a>' "
        "|| CASE WHEN p_size % 3 = 0 THEN '<a href=\"/o/r/forks\"><b class=\"text-bold\">' || p_partkey || '</b></a>' ELSE '' END "
        "|| '<li class=\"d-inline\"><a class=\"d-inline-flex flex-items-center\"><span class=\"text-bold\">' || p_brand || '</span></a></li>' "
        "|| '<article class=\"markdown-body\"><p>About ' || p_name || '</p></article>'"
    )
    rows = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.expr("'https://github.com/o/r' || p_partkey").alias("url"), html.alias("html")
    )
    found = pages.repo_fields(rows)
    return found.select(
        "page_id", "title", "description", "stars", "forks", "watching", F.array_join("languages", ",").alias("languages"),
        "readme", "commit_count", F.md5(video.repo_block(F.lit("S"))).alias("block_md5"), F.md5(video.repo_summary_input()).alias("input_md5"),
    )


@query
def media_lines(spark, sf):
    """Bare artifact lines and name links of a text turned into markdown links; artifact links; saved notes."""
    part = D.table(spark, sf, "part")
    ext = "CASE p_size % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mp3' ELSE '.bin' END"
    url = f"'https://h.example.com/' || p_partkey || {ext}"
    text = F.expr(
        f"'Top\n- ' || {url} || '\n' || CASE WHEN p_size % 3 = 0 THEN 'URLs in tweet:\n - /user' || p_partkey || '\n - https://e.example.com' ELSE ' - /user' END"
    )
    path = F.expr("CASE WHEN p_size % 5 = 0 THEN '/data/' || p_partkey || '.md' END")
    return part.select(
        "p_partkey", T.label_bare_links(text).alias("text"),
        F.array_join(report.media_links(F.expr(url), F.lit(None).cast("string"), path), "\n").alias("links"),
        report.saved_note(F.col("p_name"), path, F.lit(None).cast("string")).alias("note"), T.link_kind(F.expr(url)).alias("word"),
    )


@query
def numbered_media(spark, sf):
    """Contents of posts that tell where their media are stored, with numbered lines."""
    kinds = "CASE p_size % 4 WHEN 0 THEN '- Video: 1\n- Photo: 2' WHEN 1 THEN '- Photo: 3' WHEN 2 THEN '- Animated_gif: 1\n- Video: 1' ELSE '- Sticker: 1' END"
    urls = "array_join(transform(sequence(1, 1 + p_size % 3), i -> concat('- https://s.example.com/', p_partkey, '/', i, '.mp4')), '\n')"
    note = f"concat('Post ', p_partkey, '\n\nMedia: ', p_size, ' items detected\n\nUploaded to S3 3 media files:\n', {kinds}, '\n\nS3 Locations:\n', {urls}, '\n\nURLs in tweet:\n - https://e.example.com')"
    return D.table(spark, sf, "part").select("p_partkey", T.number_media(F.expr(note)).alias("text"))


@query
def video_names_and_playlists(spark, sf):
    """File names of videos, and the short text about a playlist, of parts and suppliers."""
    names = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), T.video_filename(F.col("p_size").cast("long"), F.concat("p_name", F.lit(" / "), "p_type")).alias("value"))
    lists = D.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.expr("CASE WHEN s_suppkey % 3 > 0 THEN 'Channel ' || s_nationkey END").alias("channel_title"),
        F.col("s_nationkey").alias("item_count"), F.lit("2024-01-02").alias("published_at"), F.lit("About").alias("description"),
        F.expr("transform(sequence(1, 7), i -> named_struct('title', concat('V', i)))").alias("videos_preview"))
    return names.unionByName(lists.select("id", video.playlist_summary_block().alias("value")))


@query
def tweet_reports(spark, sf):
    posted = T.utc_display(F.col("o_orderdate"))
    orders = D.table(spark, sf, "orders")
    urls = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array('https://e.example.com') END")
    block = media.tweet_report(
        F.expr("'u' || o_custkey"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"), posted, F.col("o_orderpriority"), urls
    )
    return orders.select("o_orderkey", block.alias("block"))


@query
def time_columns(spark, sf):
    rows = D.table(spark, sf, "events").select("event_id", "ts")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    parsed = F.when(F.col("event_id") % 4 == 0, F.lit("yesterday")).otherwise(text)
    return rows.select(
        "event_id", T.epoch_seconds(F.col("ts")).alias("epoch"), T.utc_display(F.col("ts")).alias("display"),
        T.run_stamp(F.col("ts")).alias("stamp"), F.unix_timestamp(T.iso_timestamp(parsed)).alias("parsed"),
    )


def _videos(spark, sf):
    return D.table(spark, sf, "conversations").where("turn = 0").selectExpr(
        "CAST(conv_id AS STRING) AS video_id", "'Talk ' || conv_id || ': part, one' AS title",
        "'2024-01-01' AS published_at", "text AS description",
    )


@query
def reference_records(spark, sf):
    videos = D.table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS video_id", "p_name AS title")
    rows = sinks.reference_records(videos, F.lit(1700000000))
    get = lambda k: F.get_json_object("content", f"$.{k}").alias(k)
    return rows.select("video_id", "filename", *[get(k) for k in ("youtube_video_id", "title", "url", "processed_at", "reference_type", "direct_embed_url")])


@query
def transcript_docs(spark, sf):
    docs = sinks.transcript_docs(_segments(spark, sf), _videos(spark, sf), F.lit(1700000000))
    header = F.regexp_extract("content", r"(?s)^--- Video Metadata ---\n(.*?)\n\n--- Transcript ---\n\n", 1)
    body = F.regexp_replace("content", r"(?s)^--- Video Metadata ---\n.*?\n\n--- Transcript ---\n\n", "")
    return docs.select(
        "video_id", "part", "filename",
        F.get_json_object(header, "$.title").alias("title"), F.get_json_object(header, "$.url").alias("url"),
        F.get_json_object(header, "$.transcript_language").alias("language"), F.md5(body).alias("body_md5"),
    )


@query
def page_markdown_docs(spark, sf):
    rows = D.table(spark, sf, "pages").withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE"))
    return sinks.page_markdown_docs(rows, F.col("at"))


@query
def week_partition(spark, sf):
    rows = sinks.with_week(D.table(spark, sf, "events"))
    return rows.groupBy("iso_year", "iso_week", "folder").agg(F.count(F.lit(1)).alias("n"))


def _manifest(spark, sf):
    rows = D.capture_tasks(spark, sf).join(D.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"), "id")
    named = rows.select("id", F.col("created_at").alias("ts"), F.concat(U.host(F.col("url")), F.lit(".md")).alias("filename"), "content")
    return sinks.artifact_keys(named, bucket="notes")


@query
def artifact_collisions(spark, sf):
    return sinks.artifact_collisions(_manifest(spark, sf).select("id", "key", "s3_url"))


@query
def write_artifacts(spark, sf):
    """Written by week and read back."""
    root = new_folder(spark, "artifacts")
    sinks.write_artifacts(_manifest(spark, sf).select("id", "ts", "filename", "content"), root)
    return spark.read.parquet(root).select("id", "filename", "folder", "iso_year", "iso_week", "content")


@query
def write_objects(spark, sf):
    """Written as single named objects and read back by their keys."""
    root = new_folder(spark, "objects")
    objects.write_objects(_manifest(spark, sf).select("id", "ts", "filename", "content"), root)
    read = objects.read_objects(spark, root).select("key", F.col("content").cast("string").alias("content"))
    return objects.object_manifest(spark, root).join(read, "key").select("key", "filename", F.col("shared").cast("int").alias("shared"), "content")


@query
def write_report(spark, sf):
    """Report rows written as text and read back."""
    root = new_folder(spark, "report")
    rows = report.task_report(D.capture_tasks(spark, sf), D.attempts(D.task_urls(spark, sf)))
    sinks.write_report(rows, root, "2024-06-01")
    text = spark.read.text(root).where(~F.col("value").startswith(V.REPORT_TITLE))
    return text.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("value <> ''").select("value", "n")


@query
def report_lines(spark, sf):
    """Lines of a written report in order: title, blank lines and all."""
    root = new_folder(spark, "report")
    rows = report.task_report(D.capture_tasks(spark, sf), D.attempts(D.task_urls(spark, sf)))
    sinks.write_report(rows, root, "2024-06-01")
    return sinks.read_report(spark, root, "2024-06-01")


@query
def stable_numbers(spark, sf):
    """Events of a user numbered in time order, bucketed by day."""
    rows = D.table(spark, sf, "events").select("user_id", "event_id", "ts")
    return stable_numbering(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts")).select(
        "user_id", "event_id", "number"
    )


@query
def range_numbers(spark, sf):
    """Line items numbered per flag and status: four parents hold all rows, and many rows share a date."""
    rows = D.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber")
    order = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return range_numbering(rows, ["l_returnflag", "l_linestatus"], order).select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "number")


# --- logs --------------------------------------------------------------------------------------------------------
@query
def log_noise_filter(spark, sf):
    return logs.log_noise_filter(D.log_lines(D.table(spark, sf, "events")))


@query
def log_noise_scraper(spark, sf):
    return logs.log_noise_filter(D.log_lines(D.table(spark, sf, "events")), "scraper").select("event_id", "message")


@query
def console_filter(spark, sf):
    events = D.table(spark, sf, "events")
    rows = events.select("event_id", F.expr("event_type").alias("type"), F.expr(D.LOG_MESSAGE).alias("message"))
    return logs.console_filter(rows)


@query
def apply_rules(spark, sf):
    """Documents that contain any phrase of a rule table."""
    rules = D.table(spark, sf, "part").selectExpr("explode(split(p_name, ' ')) AS phrase")
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return logs.apply_rules(docs, "text", rules).select("doc_id")


@query
def apply_many_rules(spark, sf):
    """URLs that contain any word of the benchmark."""
    rules = D.table(spark, sf, "benchmark").selectExpr("explode(split(text, ' ')) AS phrase")
    return logs.apply_rules(D.table(spark, sf, "pages").select("page_id", "url"), "url", rules)


# --- streams -------------------------------------------------------------------------------------------------------
@query
def stream_capture(spark, sf):
    root = new_folder(spark, "stream-ledger")
    store.write_changes(D.ledger(spark, sf), root, 0)
    source = D.captures(D.stream_table(spark, sf, "pages"))
    job = jobs.stream_capture(source, root, new_folder(spark, "ck"), D.attempts(D.task_urls(spark, sf)))
    job.awaitTermination()
    return store.read_ledger(spark, root).select("url", "task_id", F.col("success").cast("int").alias("success"))


def _written(spark, stream):
    path = new_folder(spark, "stream")
    jobs.append_files(stream, path, new_folder(spark, "ck")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_url_state(spark, sf):
    """Several micro-batches in order of time, so a batch meets the state that earlier ones left."""
    rows = D.stream_in_batches(spark, sf, "events", "ts").select(
        F.expr("'https://e.example.com/' || user_id").alias("url"), "ts", "event_id", (F.col("event_type") == "purchase").alias("success")
    )
    root = new_folder(spark, "url-state")
    jobs.write_updates(jobs.stream_first_success(rows, ["ts", "event_id"]), root, new_folder(spark, "ck")).awaitTermination()
    return jobs.read_first_success(spark, root, ["ts", "event_id"]).select("url", "event_id")


@query
def stream_recent_dedup(spark, sf):
    rows = D.stream_table(spark, sf, "events").select(F.expr("'https://e.example.com/' || user_id || '/' || event_type").alias("url"), "ts")
    return _written(spark, jobs.stream_recent_dedup(rows, "400 days")).select("url")


@query
def stream_outcomes(spark, sf):
    rows = D.stream_table(spark, sf, "events").select(F.col("ts").alias("processed_at"), (F.col("event_type") != "error").alias("success"))
    root = new_folder(spark, "outcomes")
    jobs.write_updates(jobs.stream_outcomes(rows), root, new_folder(spark, "ck")).awaitTermination()
    return jobs.read_updates(spark, root, ["window_start"])


@query
def stream_log_filter(spark, sf):
    return _written(spark, jobs.stream_log_filter(D.log_lines(D.stream_table(spark, sf, "events"))))
