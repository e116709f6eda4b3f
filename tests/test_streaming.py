import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linktrove import schemas
from linktrove.operators import logs
from linktrove.plans.capture_run import gated_rows
from linktrove.operators import tasks as K
from linktrove.sources import ledger as store
from linktrove.sources.scratch import scratch_root
from linktrove.streaming import jobs

START = datetime(2024, 1, 1)
ATTEMPTS = "task_id long, pos int, url string, content string, error string"


def task(i, text):
    return (i, 1, text, "", [], START + timedelta(minutes=i), i)


def source(spark, path, ddl, batches):
    """File stream of one file per batch, read one file at a time."""
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_capture_equals_batch_and_survives_replay(spark, tmp_path):
    batches = [
        [task(0, "https://a.com/1 https://youtu.be/v"), task(1, "https://a.com/2 https://a.com/1")],
        [task(2, "https://a.com/2 https://www.youtube.com/watch?v=v"), task(3, "https://colab.research.google.com/x https://a.com/9")],
        [task(4, "https://a.com/1 https://youtu.be/v https://a.com/3")],
    ]
    rows = [r for b in batches for r in b]
    tasks = spark.createDataFrame(rows, schemas.TASKS)
    bad = {(0, "https://a.com/1"), (1, "https://a.com/2"), (2, "https://www.youtube.com/watch?v=v")}
    urls = K.extract_task_urls(tasks).select("task_id", "pos", "url").collect()
    outcomes = spark.createDataFrame(
        [(r.task_id, r.pos, r.url, None if (r.task_id, r.url) in bad else "text", None) for r in urls], ATTEMPTS
    ).cache()

    root, ckpt = str(tmp_path / "ledger"), str(tmp_path / "ck")
    stream = source(spark, str(tmp_path / "in"), schemas.TASKS, batches)
    jobs.stream_capture(stream, root, ckpt, outcomes).awaitTermination()
    streamed = {(r.url, r.task_id, r.success) for r in store.read_ledger(spark, root).collect()}

    gated = gated_rows(K.notebook_gate(tasks), spark.createDataFrame([], schemas.LEDGER), outcomes)
    tried = gated.where("action = 'try'").select("url", "created_at", "task_id", "success").collect()
    last = {}
    for r in sorted(tried, key=lambda r: r.created_at):
        last[r.url] = (r.url, r.task_id, r.success)
    assert streamed == set(last.values())

    # The last batch delivered again: version folder replaced, ledger unchanged.
    again = spark.createDataFrame(batches[2], schemas.TASKS)
    before = store.read_ledger(spark, root, before=3)
    rerun = gated_rows(K.notebook_gate(again), before, outcomes).where("action = 'try'")
    store.write_changes(rerun.withColumn("processed_at", F.col("created_at")), root, 3, replay=True)
    assert {(r.url, r.task_id, r.success) for r in store.read_ledger(spark, root).collect()} == streamed


def test_url_state_keeps_failed_urls_open(spark, tmp_path):
    ddl = "url string, task_id long, success boolean"
    batches = [[("a", 1, False), ("b", 2, True), ("b", 3, True)], [("a", 4, True), ("b", 5, True)], [("a", 6, True), ("c", 7, False)]]
    stream = jobs.stream_url_state(source(spark, str(tmp_path / "in"), ddl, batches), ["task_id"])
    out = str(tmp_path / "out")
    jobs.append_files(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.url, r.task_id) for r in spark.read.parquet(out).collect()) == [("a", 4), ("b", 2)]


def test_first_success_carries_state_over_batches_and_forgets(spark, tmp_path):
    ddl = "url string, ts timestamp_ntz, task_id long, success boolean"
    day = lambda n: START + timedelta(days=n)
    batches = [
        [("a", day(0), 1, False), ("b", day(1), 3, True), ("b", day(1), 2, True)],
        [("a", day(2), 4, True), ("b", day(2), 5, True)],
        [("b", day(0), 6, True), ("a", day(3), 7, True), ("c", day(3), 8, False)],  # b: earlier time, seen later, span still open
        [("a", day(40), 9, True)],
        [("a", day(41), 10, True)],
        [("a", day(42), 11, True), ("b", day(1), 12, True), ("d", day(1), 13, True)],  # first span closed: b and d come too late
    ]
    root = str(tmp_path / "out")
    stream = jobs.stream_first_success(source(spark, str(tmp_path / "in"), ddl, batches), ["ts", "task_id"], limit="30 days")
    jobs.write_updates(stream, root, str(tmp_path / "ck")).awaitTermination()
    assert {r.url: r.task_id for r in jobs.read_first_success(spark, root, ["ts", "task_id"]).collect()} == {"a": 4, "b": 6}
    spans = sorted((r.url, r.task_id) for r in jobs.read_updates(spark, root, ["url", "span"]).collect())
    assert spans == [("a", 4), ("a", 9), ("b", 6)]


def test_stream_capture_compacts_and_clears_scratch(spark, tmp_path):
    batches = [[task(i, f"https://a.com/{i} https://a.com/{i // 2}")] for i in range(5)]
    rows = [r for b in batches for r in b]
    urls = K.extract_task_urls(spark.createDataFrame(rows, schemas.TASKS)).select("task_id", "pos", "url").collect()
    outcomes = spark.createDataFrame([(r.task_id, r.pos, r.url, "text", None) for r in urls], ATTEMPTS)
    scratch = scratch_root(spark) + "/linktrove"
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    root = str(tmp_path / "ledger")
    jobs.stream_capture(source(spark, str(tmp_path / "in"), schemas.TASKS, batches), root, str(tmp_path / "ck"), outcomes,
                        compact_every=2).awaitTermination()
    assert set(os.listdir(scratch)) == before
    assert len(os.listdir(f"{root}/kind=snap")) == 2
    assert {r.url for r in store.read_ledger(spark, root).collect()} == {f"https://a.com/{i}" for i in range(5)}


def test_recent_dedup(spark, tmp_path):
    ddl = "url string, ts timestamp_ntz"
    batches = [[("a", START), ("a", START + timedelta(minutes=1))], [("a", START + timedelta(minutes=2)), ("b", START)]]
    stream = jobs.stream_recent_dedup(source(spark, str(tmp_path / "in"), ddl, batches), "1 hour")
    out = str(tmp_path / "out")
    jobs.append_files(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_outcome_windows(spark, tmp_path):
    ddl = "processed_at timestamp_ntz, success boolean"
    batches = [
        [(START, True), (START + timedelta(hours=23), False)],
        [(START + timedelta(hours=5), True), (START + timedelta(days=5), True)],
        [(START + timedelta(days=5, hours=1), False)],
        [(START, True)],  # late: its day is closed by now
    ]
    stream = jobs.stream_outcomes(source(spark, str(tmp_path / "in"), ddl, batches))
    root = str(tmp_path / "out")
    jobs.write_updates(stream, root, str(tmp_path / "ck")).awaitTermination()
    got = {r.window_start: (r.total, r.successful, r.failed) for r in jobs.read_updates(spark, root, ["window_start"]).collect()}
    assert got == {START: (3, 2, 1), START + timedelta(days=5): (2, 1, 1)}


def test_log_filter_stream_equals_batch(spark, tmp_path):
    ddl = "ts timestamp_ntz, logger string, level string, message string"
    batches = [[(START, "main", "INFO", "keep"), (START, "main", "ERROR", "monaco")], [(START, "urllib3", "INFO", "low"), (START, "main", "INFO", "HTTP Request: HTTP/1.1 404")]]
    out = str(tmp_path / "out")
    jobs.append_files(jobs.stream_log_filter(source(spark, str(tmp_path / "in"), ddl, batches)), out, str(tmp_path / "ck")).awaitTermination()
    batch = logs.log_noise_filter(spark.createDataFrame([r for b in batches for r in b], ddl))
    key = lambda df: sorted(r.message for r in df.collect())
    assert key(spark.read.parquet(out)) == key(batch) == ["HTTP Request: HTTP/1.1 404", "keep"]


