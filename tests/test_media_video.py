import json
from datetime import datetime

from pyspark.sql import functions as F

from linktrove.operators import inference, media, pages, summary, video
from linktrove.sources import sinks, timeline


def result(tweet, author):
    return {"rest_id": tweet, "core": {"user_results": {"result": {"rest_id": author}}}}


def item(node):
    return {"itemContent": {"tweet_results": {"result": node}}}


def conversation(entries):
    return json.dumps({"data": {"threaded_conversation_with_injections_v2": {"instructions": [
        {"type": "TimelineClearCache"}, {"type": "TimelineAddEntries", "entries": entries}, {"type": "TimelineAddEntries", "entries": []},
    ]}}})


def test_timeline_and_thread_count(spark):
    full = conversation([
        {"entryId": "tweet-1", "content": item(result("1", "A"))},
        {"entryId": "tweet-12", "content": item(result("12", "B"))},
        {"entryId": "who-to-follow", "content": item(result("99", "A"))},
        {"entryId": "conversationthread-5", "content": {"items": [
            {"item": item(result("2", "A"))}, {"item": item(result("3", "B"))}, {"item": item(result("2", "A"))}, {"item": {}},
        ]}},
    ])
    raw = spark.createDataFrame([("1", full), ("7", full), ("8", conversation([])), ("9", "broken")], "focal_tweet_id string, raw string")
    entries = timeline.read_timeline(raw)
    assert [(r.tweet_id, r.author_id) for r in entries.where("focal_tweet_id = '1'").collect()] == [
        ("1", "A"), ("12", "B"), ("2", "A"), ("3", "B"), ("2", "A"),
    ]
    counts = media.thread_count(entries, raw.select("focal_tweet_id"))
    assert {r.focal_tweet_id: r.n_tweets for r in counts.collect()} == {"1": 2, "7": 0, "8": 0, "9": 0}


def variants(*rows):
    return {"variants": [{"content_type": "video/" + t, "bitrate": b, "url": u} for t, b, u in rows]}


def test_tweet_media(spark):
    listed = [
        {"type": "photo", "media_url_https": "https://h/a.png?name=x"},
        {"type": "video", "video_info": variants(("mp4", 1, "https://h/1.mp4"), ("mp4", 5, "https://h/2.mp4?t=1"), ("mp4", 5, "https://h/3.mp4"), ("x", 9, "https://h/4"))},
        {"type": "video", "video_info": variants(("x", 9, "https://h/4"))},
        {"type": "animated_gif", "video_info": variants(("x", None, "https://h/5"), ("mp4", None, "https://h/6.mp4"))},
    ]
    tweets = [
        ("1", {"legacy": {"extended_entities": {"media": listed}}}),
        ("2", {"legacy": {"entities": {"media": listed[:1]}}}),
        ("3", {"__typename": "TweetUnavailable", "legacy": {"entities": {"media": listed[:1]}}}),
        ("4", {}),
    ]
    raw = spark.createDataFrame([(i, json.dumps({"data": {"tweetResult": {"result": r}}})) for i, r in tweets], "tweet_id string, raw string")
    rows = timeline.read_tweet_media(raw)
    got = [(r.tweet_id, r["index"], r.url, r.extension) for r in media.media_items(rows).collect()]
    assert got == [
        ("1", 0, "https://h/a.png", "png"), ("1", 1, "https://h/2.mp4", "mp4"), ("1", 3, "https://h/5", "mp4"), ("2", 0, "https://h/a.png", "png"),
    ]
    best = media.media_items(rows, gif_mode="best").where("index = 3").first()
    assert best.url == "https://h/6.mp4"


def test_best_stream(spark):
    rows = [
        ("a", 0, "mp4", False, 1080), ("a", 1, "mp4", True, 360), ("a", 2, "mp4", True, 720), ("a", 3, "mp4", True, 720),
        ("b", 0, "mp4", False, 480), ("b", 1, "webm", True, 2160), ("c", 0, "webm", True, 720),
    ]
    df = spark.createDataFrame(rows, "video_id string, pos int, extension string, progressive boolean, resolution int")
    got = {r.video_id: (r.pos, r.error) for r in media.best_stream(df).collect()}
    assert got == {"a": (2, None), "b": (0, None), "c": (None, "no downloadable stream")}


def test_assemble_tweet_parts(spark):
    tweets = spark.createDataFrame([("1", "N", "h", None, 0, "T", None, None), ("2", None, None, None, None, None, ["u"], "e")],
                                   "tweet_id string, user_name string, user_handle string, created_at string, timestamp long, text string, urls array<string>, error string")
    items = spark.createDataFrame([("1", "photo", i, f"u{i}") for i in range(5)], "tweet_id string, type string, index int, url string")
    stored = spark.createDataFrame([("1", "photo", 0, "s0"), ("1", "video", 1, "s1"), ("1", "photo", 2, "s2")], "tweet_id string, type string, index int, s3_url string")
    whole = {r.tweet_id: r for r in media.assemble_tweet(tweets, items, stored).collect()}
    assert whole["1"].content == (
        "User: @h (N)  \nTweet ID: 1  \nPosted on: 1970-01-01 00:00:00 UTC  \n\n---\nT\n\nMedia: 5 items detected\n\n"
        "Uploaded to S3 3 media files:\n- Photo: 2\n- Video: 1\n\nS3 Locations:\n- s0\n- s1\n- s2"
    )
    assert whole["1"].media_urls == [f"u{i}" for i in range(5)] and whole["1"].error is None
    assert whole["2"].content == (
        "User: @unknown ()  \nTweet ID: 2  \nPosted on: Unknown\n\n---\n[No text content found]\nURLs in tweet:\n - u\n\n[Note: No media files found to process]"
    )
    assert whole["2"].error == "e"
    parts = media.assemble_tweet(tweets, items, stored, part_rows=2).where("tweet_id = '1'").orderBy("part").collect()
    assert [r.media_urls for r in parts] == [["u0", "u1"], ["u2", "u3"], ["u4"]]
    assert "\n".join(r.content for r in parts if r.content) == whole["1"].content and parts[2].content is None
    late = media.assemble_tweet(tweets, items.withColumn("index", F.col("index") + 5000), stored.withColumn("index", F.col("index") + 5000))
    assert {r.tweet_id: r.content for r in late.collect()}["1"] == whole["1"].content


def test_join_errors(one):
    assert one(media.join_errors, a="x", b=None, c="y") == "x; y"
    assert one(media.join_errors, a=None, b="") is None


def test_projections_and_missing_fields(spark):
    raw = spark.createDataFrame([("v", json.dumps({"snippet": {"title": "t"}, "statistics": {"viewCount": "12", "likeCount": "N/A"}, "contentDetails": {"caption": "true"}})), ("w", "{}")],
                                "video_id string, raw string")
    rows = {r.video_id: r for r in video.video_projection(raw).collect()}
    assert (rows["v"].title, rows["v"].view_count, rows["v"].like_count, rows["v"].caption) == ("t", 12, None, True)
    assert (rows["w"].title, rows["w"].description, rows["w"].tags, rows["w"].caption) == (None, "", [], False)
    comments = spark.createDataFrame([("v", 0, json.dumps({"snippet": {"topLevelComment": {"snippet": {"textDisplay": "hi"}}}}))], "video_id string, position int, raw string")
    c = video.comment_projection(comments).first()
    assert (c.author, c.text, c.like_count) == (None, "hi", 0)
    ch = video.channel_projection(spark.createDataFrame([("c", json.dumps({"statistics": {"subscriberCount": "5"}}))], "channel_id string, raw string")).first()
    assert ch.subscriber_count == 5 and ch.title is None


def test_assemble_video(spark):
    videos = spark.createDataFrame([("v", "c", 5, None, "PT1M", True), ("w", "x", None, None, None, None)],
                                   "video_id string, channel_id string, view_count long, like_count long, duration string, caption boolean")
    channels = spark.createDataFrame([("c", "Chan", 10, 20, None)], "channel_id string, title string, subscriber_count long, view_count long, video_count long")
    comments = spark.createDataFrame([("v", i, None if i == 0 else f"a{i}", "y" * (101 if i == 1 else 3)) for i in range(7)], "video_id string, position int, author string, text string")
    segments = spark.createDataFrame([("v", 1, "world"), ("v", 0, "hello")], "video_id string, seq long, text string")
    summaries = spark.createDataFrame([("v", "Short.")], "video_id string, summary string")
    got = {r.video_id: r for r in video.assemble_video(videos, channels, comments, segments, summaries).collect()}
    assert got["v"].content == (
        "Views: 5  \nLikes: N/A  \nDuration: PT1M  \nHas captions: True  \n   \n---\nChannel Details:  \nName: Chan  \nSubscribers: 10  \n"
        "Total Views: 20  \nTotal Videos: N/A  \n  \n---\nFull transcript length: 11 characters  \n  \nShort.\n  \nTop 5 Comments:\n"
        "1. Anonymous: yyy\n2. a1: " + "y" * 97 + "...\n3. a2: yyy\n4. a3: yyy\n5. a4: yyy\n--"
    )
    assert got["w"].content == "Views: N/A  \nLikes: N/A  \nDuration: N/A  \nHas captions: False  \n   \n---\nTranscript: Not available"


def test_transcript_parts(spark):
    rows = [("v", i, f"s{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "video_id string, seq long, text string")
    whole = "\n".join(r[2] for r in rows)
    assert [(r.text, r.n_chars) for r in video.transcript_text(df).collect()] == [(whole, len(whole))]
    parts = video.transcript_text(df, part_rows=2).orderBy("part").collect()
    assert "\n".join(r.text for r in parts) == whole and {r.n_chars for r in parts} == {len(whole)}


def test_language_rules(spark):
    known = spark.createDataFrame([("v", "en", "English", False), ("v", "de", "German", True), ("v", "de", "German", True)],
                                  "video_id string, language_code string, language_name string, is_auto_generated boolean")
    requests = spark.createDataFrame([("v", "en"), ("v", "fr"), ("x", "en")], "video_id string, language string")
    got = {(r.video_id, r.language): (r.available, r.error, r.alternatives) for r in video.language_available(requests, known).collect()}
    assert got == {("v", "en"): (True, None, None), ("v", "fr"): (False, "language_unavailable", ["de", "en"]), ("x", "en"): (False, "language_unavailable", [])}
    assert [x.language_name for x in video.languages_by_name(known).first().languages] == ["English", "German"]


def test_playlist_block(spark):
    lists = spark.createDataFrame([("p", None, None, None, 12, "d" * 301)], "playlist_id string, title string, channel_title string, published_at string, item_count int, description string")
    items = spark.createDataFrame([("p", i + 1, "t", None) for i in range(12)], "playlist_id string, position int, title string, video_id string")
    text = video.playlist_block(lists, items).first().content
    assert "d" * 297 + "..." in text and "showing first 10 of 12" in text and "10. [t](N/A)  " in text and "11. " not in text


def test_transcript_docs_and_weeks(spark, tmp_path):
    segments = spark.createDataFrame([("v", 0, "a"), ("v", 1, "b")], "video_id string, seq long, text string")
    videos = spark.createDataFrame([("v", "T: x", None, "d")], "video_id string, title string, published_at string, description string")
    doc = sinks.transcript_docs(segments, videos, F.lit(5)).first()
    header = json.loads(doc.content.split("\n\n--- Transcript ---\n\n")[0].removeprefix("--- Video Metadata ---\n"))
    assert doc.filename == "5_youtube_T_x.txt" and doc.content.endswith("\na\nb".removeprefix("\n")) and header["published_date"] is None
    assert sinks.transcript_docs(segments, videos, F.lit(5), include_metadata=False).first().content == "a\nb"
    rows = spark.createDataFrame([("f", datetime(2024, 12, 30), "c1"), ("f", datetime(2024, 1, 1), "c2")], "filename string, ts timestamp_ntz, content string")
    root = str(tmp_path / "out")
    sinks.write_artifacts(rows, root, "text")
    sinks.write_artifacts(rows, root, "text")  # a second run replaces the same names
    assert sorted(map(tuple, spark.read.text(root).select("iso_year", "iso_week", "filename", "value").collect())) == [(2024, 1, "f", "c2"), (2025, 1, "f", "c1")]
    keys = sinks.artifact_keys(rows, bucket="b")
    assert sinks.artifact_collisions(keys).count() == 0 and keys.first().s3_url == "https://b.s3.amazonaws.com/2025/week_01/f"


def test_page_attempts(spark):
    html = "<p>" + "Some long enough sentence about things. " * 3 + "</p>"
    rows = [(1, "https://a", html, False), (2, "https://b", "<p>x</p>", False), (3, "https://c", html, True), (4, "https://d", "<p>x</p>", False)]
    loaded = spark.createDataFrame(rows, "page_id long, url string, html string, timed_out boolean")
    index = spark.createDataFrame([("https://b", 2, "late", "late"), ("https://b", 1, "T", "s ..."), ("https://c", 1, None, None)], "url string, rank int, title string, snippet string")
    got = {r.page_id: r for r in pages.page_attempts(loaded, index).collect()}
    assert got[1].extraction_method == "pandoc_llm" and got[1].error is None and "Some long enough" in got[1].content
    assert (got[2].content, got[2].error, got[2].extraction_method) == ("Title: T | Description: s", None, "google_search")
    assert got[3].content.startswith("[Error: Page load timed out, and") and got[3].error == "Page load timeout"
    assert got[4].content.startswith("[Error: Content extraction failed, and")
    off = {r.page_id: r.content for r in pages.page_attempts(loaded, index, enabled=False).collect()}
    assert off[2] == "[Error: Content extraction failed, search fallback disabled]" and off[3].endswith("search fallback disabled]")

    def make_fn():
        return lambda prompts: [p[-20:] for p in prompts]

    answered = {r.page_id: r.content for r in pages.page_attempts(loaded, index, make_fn=make_fn).collect()}
    assert answered[1] == "sentence about things." [-20:]


def test_summary_budget(spark):
    text = "Rare alpha beta. " + "common words here. " * 5 + "Another rare gamma"
    docs = spark.createDataFrame([(1, text), (2, "common words here."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in summary.extractive_summary(docs, max_words=6).collect()}
    assert got[1].summary == "Rare alpha beta. Another rare gamma" and got[1].n_words == 6
    assert got[2].summary == "common words here." and got[3].summary is None


def test_model_failures_become_row_text(spark):
    def make_fn():
        def answer(prompts):
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return answer

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "b")], "i int, prompt string").coalesce(1)
    got = {r.i: r.summary for r in inference.summarize_with(df, make_fn).collect()}
    assert got == {1: "A", 2: "Error generating summary: no", 3: None, 4: "B"}


def test_model_calls_hold_their_own_prompts_only(spark):
    def make_fn():
        import tracemalloc

        calls = []

        def answer(prompts):
            calls.append(0)
            if len(calls) == 150:  # within the second batch, when modules are loaded
                tracemalloc.start()
            peak = tracemalloc.get_traced_memory()[1]
            if prompts[-1].startswith("last"):
                tracemalloc.stop()
            return [str(peak)] * len(prompts)

        return answer

    # batches of 2 MB, whose strings take four times as much; calls of ten prompts
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "1000")
    try:
        df = spark.range(3000, numPartitions=1).selectExpr("id", "rpad(if(id = 2999, 'last', string(id)) || '\U0001f4c4', 2000, 'x') AS prompt", "id AS n")
        got = inference.summarize_with(df, make_fn, batch_chars=20_000).collect()
    finally:
        spark.conf.unset(name)
    assert [(r.id, r.n, len(r.prompt)) for r in got] == [(i, i, 2000) for i in range(3000)]
    peak = max(int(r.summary) for r in got)
    assert 0 < peak < 6_000_000


def test_answers_keep_their_rows_and_columns(spark):
    def make_fn():
        return lambda prompts: [f"{len(prompts)} {p}" for p in prompts]

    rows = [(2**60 + 1, "a", "old"), (None, None, None), (3, "bb", None), (4, "", "old"), (5, None, None), (6, "cccc", None)]
    df = spark.createDataFrame(rows, "i long, prompt string, summary string").coalesce(1)
    got = [tuple(r) for r in inference.summarize_with(df, make_fn, batch_chars=3).collect()]
    assert got == [(2**60 + 1, "a", "3 a"), (None, None, None), (3, "bb", "3 bb"), (4, "", "3 "), (5, None, None), (6, "cccc", "1 cccc")]
    assert inference.summarize_with(df.where("false"), make_fn).count() == 0
