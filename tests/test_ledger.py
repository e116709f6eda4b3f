import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linktrove.operators import aliases, ledger
from linktrove.operators.grouping import ordered_parts, range_numbering, stable_numbering
from linktrove.sources import ledger as store
from linktrove.sources.scratch import materialize

ROW = "created_at timestamp_ntz, task_id long, pos int, url string, video_id string, success boolean"
LEDGER = "url string, task_id long, processed_at timestamp_ntz, success boolean"
START = datetime(2024, 1, 1)


def random_rows(seed, tasks=120, urls=12, hot=0.4, chance=0.15):
    rng = random.Random(seed)
    names = [(f"https://p{i}", None) for i in range(urls)]
    names += [(f"https://v{i}/{form}", f"id{i}") for i in range(4) for form in "abc"]
    rows = []
    for task in range(tasks):
        picked = rng.sample(names, rng.randint(0, 6))
        if rng.random() < hot:  # one video in a large share of all tasks
            picked = [n for n in picked if n[1] != "id0"] + [(f"https://v0/{f}", "id0") for f in rng.sample("abc", rng.randint(1, 3))]
        made = START + timedelta(minutes=rng.randint(0, 40))
        rows += [(made, task, pos, u, v, rng.random() < chance) for pos, (u, v) in enumerate(picked)]
    return rows


def sequential(rows, done):
    """The plain loop: tasks in order, ledger updated after every try."""
    done, out = set(done), {}
    by_task = {}
    for r in rows:
        by_task.setdefault((r[0], r[1]), []).append(r)
    for key in sorted(by_task):
        seen = set()
        for _, task, pos, url, video, success in sorted(by_task[key], key=lambda r: r[2]):
            if url in done:
                out[task, pos] = "ledger_skip"
            elif video is not None and video in seen:
                out[task, pos] = "duplicate"
            else:
                out[task, pos] = "try"
                if video is not None:
                    seen.add(video)
                if success:
                    done.add(url)
    return out


@pytest.mark.parametrize("seed, chance", [(1, 0.15), (2, 0.5), (3, 0.9), (4, 0.03)])
def test_gate_with_aliases_equals_the_sequential_loop(spark, seed, chance):
    rows = random_rows(seed, chance=chance)
    done = ["https://p0", "https://v1/a"]
    base = spark.createDataFrame([(u, 0, START, True) for u in done] + [("https://p1", 0, START, False)], LEDGER)
    got = aliases.gate_with_aliases(spark.createDataFrame(rows, ROW), base).collect()
    assert {(r.task_id, r.pos): r.action for r in got} == sequential(rows, done)
    assert len(got) == len(rows)


def test_gate_resolves_a_chain_of_dependences(spark):
    """Each task's second URL can only be tried because of the task before it."""
    rows = []
    for i in range(6):
        rows += [(START + timedelta(minutes=i), i, 0, f"u{i}", "v", False), (START + timedelta(minutes=i), i, 1, f"u{i + 1}", "v", True)]
    rows[0] = rows[0][:5] + (True,)
    rows.append((START + timedelta(minutes=9), 9, 0, "u3", "v", True))
    got = aliases.gate_with_aliases(spark.createDataFrame(rows, ROW), spark.createDataFrame([], LEDGER)).collect()
    assert {(r.task_id, r.pos): r.action for r in got} == sequential(rows, [])


def test_long_chains_settle_in_few_tables(spark, monkeypatch):
    """10 000 tasks that wait for each other, one chain broken in the middle, and a ring."""
    rows = []
    for i in range(10_000):
        at = START + timedelta(minutes=i)
        rows += [(at, i, 0, f"u{i}", "v", i == 0), (at, i, 1, f"u{i + 1}", "v", True)]
        rows += [(at, i, 2, f"w{i}", "w", i == 0), (at, i, 3, f"w{i + 1}", "w", i != 5000)]
    for i in range(50):
        at = START + timedelta(minutes=i)
        rows += [(at, i, 4, f"r{i}", "r", False), (at, i, 5, f"r{(i + 1) % 50}", "r", True)]
    stored = []
    monkeypatch.setattr(aliases, "materialize", lambda df, name, spark=None: stored.append(name) or materialize(df, name, spark))
    got = aliases.gate_with_aliases(spark.createDataFrame(rows, ROW), spark.createDataFrame([], LEDGER)).collect()
    assert {(r.task_id, r.pos): r.action for r in got} == sequential(rows, [])
    assert len(stored) <= 15


def test_waits_for_several_urls_and_repeated_chances(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        at = START + timedelta(minutes=i // 2)
        picked = rng.sample([f"s{k}" for k in range(max(0, i // 10 - 2), i // 10 + 4)], rng.randint(2, 4))
        rows += [(at, i, p, u, "s", rng.random() < 0.4) for p, u in enumerate(picked)]
    got = aliases.gate_with_aliases(spark.createDataFrame(rows, ROW), spark.createDataFrame([], LEDGER)).collect()
    assert {(r.task_id, r.pos): r.action for r in got} == sequential(rows, [])


def test_plain_gate_equals_the_loop_when_urls_do_not_share_videos(spark):
    rows = [r for r in random_rows(5) if r[4] is None]
    base = spark.createDataFrame([("https://p0", 0, START, True)], LEDGER)
    got = ledger.gate_rows(spark.createDataFrame(rows, ROW), base).collect()
    assert {(r.task_id, r.pos): r.action for r in got} == sequential(rows, ["https://p0"])


def test_plain_gate_on_recorded_attempts(spark):
    """Rows that were never tried carry NULL: the recorded run is reproduced."""
    rows = random_rows(6)
    actions = sequential(rows, [])
    recorded = [r[:5] + ((r[5] if actions[r[1], r[2]] == "try" else None),) for r in rows]
    got = ledger.gate_rows(spark.createDataFrame(recorded, ROW), spark.createDataFrame([], LEDGER)).collect()
    assert {(r.task_id, r.pos): r.action for r in got} == actions


def test_at_most_one_success_per_url(spark):
    gated = aliases.gate_with_aliases(spark.createDataFrame(random_rows(9), ROW), spark.createDataFrame([], LEDGER))
    per_url = gated.where("action = 'try' AND success").groupBy("url").count()
    assert per_url.where("count > 1").count() == 0


def test_unseen_keeps_failed_urls(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "url string")
    base = spark.createDataFrame([("a", 1, START, True), ("b", 1, START, False)], LEDGER)
    assert sorted(r.url for r in ledger.unseen_urls(urls, base).collect()) == ["b", "c"]


def test_upsert_last_write_wins_and_url_stays_unique(spark):
    base = spark.createDataFrame([("a", 1, START, False), ("b", 1, START, True)], LEDGER)
    updates = spark.createDataFrame(
        [("a", 2, START, True, 1), ("a", 3, START, False, 2), ("c", 4, START, True, 1)], LEDGER + ", seq int"
    )
    got = {r.url: (r.task_id, r.success) for r in ledger.ledger_upsert(base, updates, ["seq"]).collect()}
    assert got == {"a": (3, False), "b": (1, True), "c": (4, True)}
    stats = ledger.ledger_stats(ledger.ledger_upsert(base, updates, ["seq"])).first()
    assert (stats.total, stats.successful, stats.failed) == (3, 2, 1)


def test_empty_ledger_stats(spark):
    stats = ledger.ledger_stats(spark.createDataFrame([], LEDGER)).first()
    assert (stats.total, stats.successful, stats.failed) == (0, 0, 0)


def test_change_log(spark, tmp_path):
    root = str(tmp_path / "ledger")
    assert store.read_ledger(spark, root).count() == 0
    for version, rows in enumerate([[("a", 1, START, False), ("b", 1, START, True)], [("a", 2, START, True)], [("c", 3, START, False)]]):
        assert store.next_version(spark, root) == version
        store.write_changes(spark.createDataFrame(rows, LEDGER), root, version)
    state = lambda **kw: {r.url: r.task_id for r in store.read_ledger(spark, root, **kw).collect()}
    assert state() == {"a": 2, "b": 1, "c": 3}
    assert state(before=1) == {"a": 1, "b": 1}
    assert store.compact_ledger(spark, root) == 2
    assert state() == {"a": 2, "b": 1, "c": 3}
    store.write_changes(spark.createDataFrame([("b", 9, START, True)], LEDGER), root, 3)
    store.write_changes(spark.createDataFrame([("b", 8, START, True)], LEDGER), root, 3, replay=True)  # replay replaces
    assert state() == {"a": 2, "b": 8, "c": 3}


def test_video_dedup_ignores_rows_without_video(spark):
    rows = [(START, 1, 0, "a", "x", None), (START, 1, 1, "b", "x", None), (START, 1, 2, "c", None, None), (START, 1, 3, "d", None, None)]
    got = {r.pos: r.duplicate for r in ledger.video_dedup(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False}


def test_numbering_across_buckets(spark):
    rows = [("p", i) for i in range(1000)] + [("q", 5), (None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "parent string, i int")
    got = stable_numbering(df, ["parent"], [F.col("i")], F.floor(F.col("i") / 64)).collect()
    assert {(r.parent, r.i): r.number for r in got} == {
        **{("p", i): i + 1 for i in range(1000)}, ("q", 5): 1, (None, 7): 1, (None, 8): 2
    }


def test_long_groups_are_cut_into_ordered_parts(spark):
    df = spark.createDataFrame([("k", i, str(i)) for i in range(25)] + [("l", 0, "x")], "k string, i int, v string")
    parts = ordered_parts(df, ["k"], "i", F.col("v"), "vs", part_rows=10).orderBy("k", "part").collect()
    assert [(r.k, r.part, len(r.vs)) for r in parts] == [("k", 0, 10), ("k", 1, 10), ("k", 2, 5), ("l", 0, 1)]
    assert [v for r in parts if r.k == "k" for v in r.vs] == [str(i) for i in range(25)]


def test_parts_of_sparse_and_repeated_positions(spark):
    df = spark.createDataFrame([("k", 1000 + 500 * i, f"{i:02}") for i in range(12)] + [("r", 7, f"{i:02}") for i in range(12)], "k string, i int, v string")
    parts = ordered_parts(df, ["k"], "i", F.col("v"), "vs", part_rows=5).orderBy("k", "part").collect()
    assert [(r.k, r.part, len(r.vs)) for r in parts] == [(k, p, n) for k in "kr" for p, n in ((0, 5), (1, 5), (2, 2))]
    assert [v for r in parts if r.k == "r" for v in r.vs] == [f"{i:02}" for i in range(12)]


def test_a_read_of_named_urls_is_one_pruned_scan(spark, tmp_path):
    root = str(tmp_path / "ledger")
    for version in range(5):
        rows = spark.range(200 * version, 200 * version + 300).selectExpr(
            "'https://x/' || id AS url", f"{version}L AS task_id", "timestamp_ntz'2024-01-01 00:00:00' AS processed_at", "id % 2 = 0 AS success")
        store.write_changes(rows, root, version)
    asked = spark.createDataFrame([("https://x/250",), ("https://x/7",), ("https://x/7",), ("no",), (None,)], "url string")
    found = store.read_ledger(spark, root, urls=asked)
    plan = found._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "dynamicpruning" in physical and physical.count("FileScan parquet") == 1
    assert {r.url: r.task_id for r in found.collect()} == {"https://x/250": 1, "https://x/7": 0}
    whole = {(r.url, r.task_id, r.success) for r in store.read_ledger(spark, root).collect()}
    assert len(whole) == 1100
    assert store.compact_ledger(spark, root, before=3) == 2 and store.compact_ledger(spark, root) == 4
    assert {(r.url, r.task_id, r.success) for r in store.read_ledger(spark, root).collect()} == whole
    assert store.read_ledger(spark, root, before=3).count() == 700
    assert store.drop_compacted(spark, root) == [0, 1, 2, 3, 4] and store.next_version(spark, root) == 5
    assert {(r.url, r.task_id, r.success) for r in store.read_ledger(spark, root).collect()} == whole


def test_empty_changes_are_a_version(spark, tmp_path):
    root = str(tmp_path / "ledger")
    store.write_changes(spark.createDataFrame([], LEDGER), root, 0)
    assert store.next_version(spark, root) == 1 and store.read_ledger(spark, root).count() == 0
    store.write_changes(spark.createDataFrame([("a", 1, START, True)], LEDGER), root, 1)
    assert [r.url for r in store.read_ledger(spark, root, urls=spark.createDataFrame([("a",)], "url string")).collect()] == ["a"]


def test_equal_positions_of_one_parent_are_numbered_by_many_tasks(spark):
    rows = spark.range(1_000_000).selectExpr("CASE WHEN id < 999990 THEN 'hot' WHEN id < 999995 THEN 'q' END AS parent", "0 AS i", "id % 10 AS v")
    got = range_numbering(rows, ["parent"], [F.col("i"), F.col("v")], partitions=16).withColumn("task", F.spark_partition_id())
    stats = {r.parent: r for r in got.groupBy("parent").agg(
        F.count("*").alias("n"), F.count_distinct("number").alias("d"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.count_distinct("task").alias("tasks"), F.count_if(F.col("v") != F.floor((F.col("number") - 1) / 99999)).alias("off")).collect()}
    assert {p: (r.n, r.d, r.low, r.high) for p, r in stats.items()} == {"hot": (999990, 999990, 1, 999990), "q": (5, 5, 1, 5), None: (5, 5, 1, 5)}
    assert stats["hot"].off == 0
    plan = got._jdf.queryExecution().toString()
    assert "_slot" in plan and rows.count() == got.count()
    most = range_numbering(rows, ["parent"], [F.col("i")], partitions=16)
    stored = [f for f in most.inputFiles()]
    assert len({f for f in stored if f.endswith(".parquet")}) >= 12
