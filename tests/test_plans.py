"""What the plans must look like, so that the jobs hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from linktrove.plans import queries as Q
from linktrove.plans import views as D
from linktrove.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PYTHON_BY_NATURE = {"summarize_with", "stream_url_state"}
# These run jobs (stored tables, streams, rounds) while they are planned.
RUNS_JOBS = {
    "attempt_gate", "gate_rows", "gate_with_aliases", "task_outcome", "run_summary", "task_report", "run_ledger_changes", "ledger_store",
    "write_artifacts", "write_report", "page_attempts", "apply_rules", "apply_many_rules",
}
PLANNED = [n for n in QUERIES if n not in PYTHON_BY_NATURE | RUNS_JOBS and not n.startswith("stream_")]


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Plans as they are for tables that are not small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", PLANNED)
def test_native_and_partitioned(no_broadcast, name):
    text = plan(QUERIES[name](no_broadcast, SMALL))
    assert not re.search("Python|ArrowEval|MapInPandas|FlatMapGroups", text), "Python worker in a native job"
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    # A window without partition keys would put everything in one task.
    assert not re.search(r"windowspecdefinition\((?:\w+#\d+L? (?:ASC|DESC))", text), "unpartitioned window"
    physical = text.split("== Physical Plan ==")[1]
    for match in re.finditer(r"Exchange SinglePartition", physical):
        before = physical[:match.start()].rsplit("\n", 2)[-2]
        assert "HashAggregate(keys=[]" in before or "SortAggregate(key=[]" in before or "ObjectHashAggregate(keys=[]" in before, before


def test_scan_reads_only_needed_columns(spark):
    text = plan(Q.clean_url(spark, SMALL))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text
    text = plan(Q.extract_urls(spark, SMALL))
    assert "html" not in text.split("ReadSchema")[-1]


def test_filter_reaches_the_scan(spark):
    text = plan(D.table(spark, SMALL, "events").where("event_type = 'error'"))
    assert "EqualTo(event_type,error)" in text


@pytest.mark.parametrize("name", ["best_variant", "preview_n", "top_comments"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    physical = plan(QUERIES[name](spark, SMALL)).split("== Physical Plan ==")[1]
    assert re.search(r"WindowGroupLimit.*Partial", physical), "a hot key would travel whole"


def test_limit_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in plan(Q.oldest_tasks(spark, SMALL))


@pytest.mark.parametrize("name", ["attempt_gate", "video_dedup", "unseen_urls", "ledger_upsert", "thread_count", "artifact_collisions"])
def test_hot_keys_meet_no_window_or_list(spark, name):
    physical = plan(QUERIES[name](spark, SMALL)).split("== Physical Plan ==")[1]
    assert "Window " not in physical and "collect_list" not in physical


def test_extraction_is_row_local(spark):
    physical = plan(D.captures(spark.read.parquet(f"{SMALL}/pages.parquet")).select(F.col("id"))).split("== Physical Plan ==")[1]
    assert "Exchange" not in physical
