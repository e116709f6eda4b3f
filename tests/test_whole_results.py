"""Nested elements, whole-text prompts, numbered media, report title and order: hand-written values."""

from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import html as H
from linktrove.functions import text as T
from linktrove.operators import inference, media, outcomes, pages, summary
from linktrove.sources import sinks


def test_elements_end_at_their_own_tag(spark):
    cases = [
        ('<div id="a">x<div>y</div>z</div>w', ["x<div>y</div>z"]),
        ('<div id="a">one</div><p><div id="a">two<br>b<img src="/>"></div>', ["one", 'two<br>b<img src="/>">']),
        ('<div id="a"><div id="a">inner</div></div>', ['<div id="a">inner</div>']),
        ('<div id="a">cut <b>off', ["cut <b>off"]),
        ('<div id="a"/>no<div id="a" title="</div>"><!-- </div> --> 1 < 2</div>', ["<!-- </div> --> 1 < 2"]),
        ("no tags", []), ("", []), (None, []),
    ]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(cases)], "k int, h string")
    got = {r.k: r.e for r in df.select("k", H.elements(F.col("h"), r'(?i)^<div\b[^>]*id="a"').alias("e")).collect()}
    assert got == {k: e for k, (_, e) in enumerate(cases)}
    child = spark.createDataFrame([("<b>x</b><span>1</span><div><span>2</span></div><span>3</span>",), ("t<div><i></i><span>4</span><p><span>5</span></div>",)], "h string")
    span = r"(?i)^<span\b"
    rows = child.select(H.elements(F.col("h"), span, direct=True).alias("d"), H.elements(F.col("h"), span, first_child=True).alias("f")).collect()
    assert rows[0].d == ["1", "3"] and rows[0].f == ["2"] and rows[1].d == []


def test_post_fields(spark):
    html = ('<div data-testid="User-Name"><a><div><span>Ann <i>B</i></span><span>x</span></div></a><div dir="ltr"> @ann_b </div></div>'
            '<div data-testid="tweetText"><span>Hello <div>deep</div></span> bare <span>world &amp; all</span></div><time datetime="2024-05-06T07:08:09Z">May</time>')
    rows = [(1, "u", html), (2, "u", "<p>nothing</p>"), (3, "u", None), (4, "u", '<time datetime="soon"></time>')]
    got = {r.page_id: r for r in pages.post_fields(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert (got[1].user_name, got[1].user_handle, got[1].text) == ("Ann B", "ann_b", "Hello deep world & all")
    assert (got[1].created_at, got[1].timestamp, got[1].urls) == ("2024-05-06T07:08:09Z", 1714979289, [])
    assert all((got[k].user_name, got[k].text, got[k].timestamp) == ("", "", None) for k in (2, 3, 4)) and got[4].created_at == "soon"


def test_every_character_of_a_long_text_is_in_a_prompt(spark):
    text = "".join(chr(0x4E00 + k % 20_000) for k in range(1_000_000))
    rows = [(1, "webpage", text), (2, "pdf", "[Error: no text]"), (3, "youtube", ""), (4, "github", None), (5, "webpage", "short"), (6, "other", "x")]
    df = spark.createDataFrame(rows, "doc_id int, kind string, text string")
    prompts = inference.chunk_prompts(df, chunk_chars=14_000, overlap=400).where("doc_id = 1").orderBy("part").collect()
    head = inference.TEMPLATES["webpage"]
    whole, n = "", len(prompts)
    for k, p in enumerate(prompts):
        start = f"{head} (Part {k + 1} of {n}){V.PROMPT_HEADERS['webpage']}"
        assert p.prompt.startswith(start) and len(p.prompt) - len(start) <= 14_000
        chunk = p.prompt[len(start):]
        assert not whole or whole.endswith(chunk[:400])
        whole += chunk[400:] if whole else chunk
    assert whole == text

    def model():
        def answer(asked):
            return [f"<{len(a)}>" for a in asked]
        return answer

    got = {r.doc_id: r.summary for r in inference.summarize_tree(df, model, chunk_chars=14_000, overlap=400).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[2] == "[Error: no text]"
    assert got[3] == V.NO_TRANSCRIPT_ANSWER and got[4] == V.NO_TEXT_ANSWER
    assert got[1].startswith("<") and got[5] == f"<{len(head + V.PROMPT_HEADERS['webpage'] + 'short')}>"


def test_an_error_answer_ends_its_text(spark):
    def model():
        def answer(asked):
            if any("(Part 3 of" in a for a in asked):
                raise RuntimeError("refused")
            return ["fine"] * len(asked)
        return answer

    df = spark.createDataFrame([(1, "pdf", "x" * 900), (2, "pdf", "y" * 150)], "doc_id int, kind string, text string")
    got = {r.doc_id: r.summary for r in inference.summarize_tree(df, model, chunk_chars=100, overlap=10, fan_in=2, max_attempts=1).collect()}
    assert got == {1: f"{V.SUMMARY_ERROR_PREFIX} refused", 2: "fine"}


def test_stop_words_travel_by_broadcast(spark):
    docs = spark.createDataFrame([(k, "the of the and. The end " + f"w{k}.") for k in range(50)], "doc_id int, text string")
    parsed = summary.parsed_texts(docs)
    plan = summary.sentence_scores(parsed, "doc_id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and plan.count("regexp_extract_all") == 0
    rows = summary.extractive_summary(docs).collect()
    assert len(rows) == 50 and all(r.n_words == 7 for r in rows)


def test_numbered_media(one):
    note = ("Text\n\nMedia: 3 items detected\n\nDownloaded and uploaded to S3 3 media files:\n- Photo: 2\n- Video: 1\n\nS3 Locations:\n"
            "- https://s/a.jpg\n- https://s/b.jpg\n- https://s/c.mp4")
    assert one(T.number_media, t=note) == "Text\n\nMedia: 3 items detected\n\n- [Photo: 1](https://s/a.jpg)\n- [Photo: 2](https://s/b.jpg)\n- [Photo: 3](https://s/c.mp4)\n"
    for plain in ("Media: 3 items detected", "S3 Locations:\n- https://s/a", "", "x"):
        assert one(T.number_media, t=plain) == plain


def test_report_title_order_and_empty_run(spark, tmp_path):
    rows = [(k, p, f"## Task {k}.{p}\n\nbody\n") for k in range(40) for p in range(2)]
    table = spark.createDataFrame(rows, "task_id long, part int, markdown string").repartition(5)
    sinks.write_report(table, str(tmp_path), "2024-06-01")
    got = [r.value for r in sinks.read_report(spark, str(tmp_path), "2024-06-01").orderBy("n").collect()]
    assert got == "\n".join(["# Capture Report - 2024-06-01\n", *[m for _, _, m in rows]]).split("\n")
    sinks.write_report(table.limit(0), str(tmp_path), "2024-06-02", title="# Mine")
    assert [r.value for r in sinks.read_report(spark, str(tmp_path), "2024-06-02").orderBy("n").collect()] == ["# Mine", V.EMPTY_REPORT]


def test_author_of_the_focal_entry(spark):
    rows = [("1", "tweet-1", "1", "ann"), ("1", "conversationthread-2", "1", "bob"), ("1", "conversationthread-2", "5", "ann"),
            ("1", "conversationthread-3", "6", "bob"), ("2", "tweet-22", "2", "cat"), ("2", "conversationthread-1", "3", "cat")]
    entries = spark.createDataFrame(rows, "focal_tweet_id string, entry_id string, tweet_id string, author_id string")
    assert {r.focal_tweet_id: r.n_tweets for r in media.thread_count(entries).collect()} == {"1": 2, "2": 0}


def test_an_empty_batch_has_a_row(spark):
    results = spark.createDataFrame([("a", True), ("a", False), (None, True)], "b string, success boolean")
    batches = spark.createDataFrame([("a",), ("e",), ("e",)], "b string")
    got = {r.b: (r.total, r.successful, r.failed, r.success) for r in outcomes.batch_summary(results, "b", batches=batches).collect()}
    assert got == {"a": (2, 1, 1, True), "e": (0, 0, 0, False), None: (1, 1, 0, True)}
