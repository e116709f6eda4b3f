"""Answers that must not depend on the size of a text, a key or a ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linktrove import schemas
from linktrove.operators import pages, summary, video
from linktrove.sources import ledger as store
from linktrove.sources import sinks
from linktrove.streaming import jobs
from test_streaming import ATTEMPTS, task

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("text, expected", [
    ("One. Two! three\nfour", ["One.", "Two!", "three", "four"]),
    ("see example.org/2.5 now. ok", ["see example.org/2.5 now.", "ok"]),
    ("...lead a . b", ["lead a .", "b"]),
    ("", []),
    (None, []),
])
def test_sentences(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(summary.sentences(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("piece", ["1.5,", "a."])
def test_sentences_of_a_long_dotted_token(spark, piece):
    df = spark.range(1).select(F.repeat(F.lit(piece), 250_000).alias("t"))
    assert df.select(F.size(summary.sentences(F.col("t")))).first()[0] == 1


def test_preview_returns_what_was_asked(spark):
    items = spark.range(70).select(F.lit("p").alias("playlist_id"), F.col("id").alias("position"))
    assert video.preview_n(items, 60).count() == 60


def test_hidden_anchors_are_no_links(spark):
    html = "<!-- <a href='/c'>c</a> --><script>var x = \"<a href='/s'>s</a>\";</script><a href='/seen'>t</a>"
    rows = spark.createDataFrame([(1, "https://h.com/p", html)], "page_id long, url string, html string")
    assert [r.href for r in pages.page_links(rows).collect()] == ["/seen"]


def test_transcript_without_video_row_is_kept(spark):
    segments = spark.createDataFrame([("v", 0, "hello"), ("w", 0, "there")], "video_id string, seq int, text string")
    videos = spark.createDataFrame([("v", "T", None, None)], "video_id string, title string, published_at string, description string")
    rows = {r.video_id: r for r in sinks.transcript_docs(segments, videos, F.lit(1)).collect()}
    assert rows["w"].filename == "w.txt" and rows["w"].content == "there"
    assert rows["v"].content.endswith("hello") and rows["v"].content.startswith("--- Video Metadata")


def _ledger(spark, url, success=True):
    return spark.createDataFrame([(url, 1, T0, success)], schemas.LEDGER)


def test_two_runs_cannot_take_one_version(spark, tmp_path):
    root = str(tmp_path / "l")
    store.write_changes(_ledger(spark, "a"), root, 0)
    with pytest.raises(Exception, match="(?i)exists"):
        store.write_changes(_ledger(spark, "b"), root, 0)


def test_stream_starts_behind_an_existing_ledger(spark, tmp_path):
    root, ck = str(tmp_path / "l"), str(tmp_path / "ck")
    for v in range(3):
        store.write_changes(_ledger(spark, f"https://a.com/{v}"), root, v)
    store.compact_ledger(spark, root)
    tasks = spark.createDataFrame([task(9, "go https://a.com/1 https://a.com/9")], schemas.TASKS)
    folder = str(tmp_path / "in")
    tasks.write.parquet(folder)
    attempts = spark.createDataFrame([(9, k, u, "text", None) for k, u in enumerate(["https://a.com/1", "https://a.com/9"])], ATTEMPTS)
    for _ in range(2):
        jobs.stream_capture(spark.readStream.schema(schemas.TASKS).parquet(folder), root, ck, attempts).awaitTermination()
    assert {r.url for r in store.read_ledger(spark, root).collect()} == {f"https://a.com/{v}" for v in (0, 1, 2, 9)}
    assert store.base_version(spark, root, ck) == 3
