from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linktrove.operators import outcomes as O
from linktrove.operators import tasks as K
from linktrove.plans.capture_run import CaptureRun
from linktrove.sources.tasks import flatten_pages, read_task_pages

LABEL = "not-scrapeable"
TASKS = "id long, project_id long, content string, description string, labels array<string>, created_at timestamp_ntz, input_pos long"
ATTEMPT = (
    "task_id long, pos int, url string, type string, content string, error string, extraction_method string, s3_url string, "
    "downloaded_video_path string, downloaded_markdown_path string, downloaded_pdf_path string"
)
START = datetime(2024, 1, 1)


@pytest.mark.parametrize("content, error, expected", [
    ("text", None, "ok"),
    ("text", "", "ok"),
    ("Error generating summary: x", None, "llm_error"),
    ("text", "Error calling LLM: x", "llm_error"),
    ("now Error calling LLM then", None, "llm_error"),
    ("[Error: x]", "x", "extract_error"),
    ("text", "upload failed", "extract_error"),
    (None, "x", "extract_error"),
    (None, None, "no_content"),
    ("", None, "no_content"),
])
def test_error_class(one, content, error, expected):
    assert one(O.error_class, c=content, e=error) == expected


def test_hidden_error(one):
    assert one(O.hidden_summary_error, c="Views: 1\nError generating summary: x") is True
    assert one(O.hidden_summary_error, c="Error generating summary: x") is False


def run(spark, cases, no_close=False, ledger=()):
    """``cases``: per task (labels, [(content, error), ...]); each attempt gets its own URL."""
    tasks, attempts = [], []
    for i, (labels, results) in enumerate(cases):
        urls = [f"https://h.com/{i}/{n}" if not isinstance(r, str) else r for n, r in enumerate(results)]
        tasks.append((i, 7, " ".join(urls) or "nothing", "", labels, START + timedelta(minutes=i), i))
        attempts += [
            (i, n, urls[n], "webpage", r[0], r[1], None, None, None, None, None)
            for n, r in enumerate(results) if not isinstance(r, str)
        ]
    projects = spark.createDataFrame([(6, "Inbox", 0), (7, "Capture", 1)], "id long, name string, input_pos long")
    base = spark.createDataFrame([(u, 0, START, True) for u in ledger], "url string, task_id long, processed_at timestamp_ntz, success boolean")
    return CaptureRun(spark.createDataFrame(tasks, TASKS), projects, base, spark.createDataFrame(attempts, ATTEMPT), "2024-06-01 00:00:00", no_close=no_close)


OK, NONE = ("text", None), (None, None)
CASES = [
    ([LABEL], [OK]),                                              # 0 label
    ([], ["https://colab.research.google.com/drive/1"]),          # 1 notebook
    ([], []),                                                     # 2 no URLs
    ([], ["https://old.com/a"]),                                  # 3 all known
    ([], [NONE]),                                                 # 4 nothing ok
    ([], [OK, NONE]),                                             # 5 one ok
    ([], [OK, ("Error generating summary: x", "e")]),             # 6 model error
    ([], [OK, ("[Error: x]", "x")]),                              # 7 extraction error
    ([], [OK, ("Error generating summary: x", None)]),            # 8 counted failed only
    (["a"], [OK, ("text", "upload failed")]),                     # 9 other error
]


def test_task_status_rules(spark):
    done = run(spark, CASES, ledger=["https://old.com/a"])
    rows = {r.task_id: r for r in done.outcomes.collect()}
    assert {i: r.status for i, r in rows.items()} == {
        0: "skipped", 1: "skipped", 2: "failed", 3: "closed", 4: "failed", 5: "closed", 6: "failed", 7: "failed", 8: "closed", 9: "closed",
    }
    assert {i for i, r in rows.items() if LABEL in r.labels} == {0, 1, 2, 4, 6, 7}
    assert rows[9].labels == ["a"]
    assert rows[8].counted_as == "failed"
    assert {i for i, r in rows.items() if r.in_report} == {5, 9}
    summary = done.summary.first()
    assert (summary.total_tasks_considered, summary.successful_tasks, summary.failed_tasks) == (10, 3, 5)
    assert (summary.skipped_tasks, summary.notebook_tasks_skipped, summary.tasks_remaining_in_capture) == (2, 1, 6)
    assert (summary.skipped_urls, summary.processed_urls) == (1, 11)
    assert {r.task_id for r in done.report.collect()} == {5, 9}
    assert done.ledger_changes.count() == 11


def test_no_close(spark):
    assert [r.status for r in run(spark, [([], [OK])], no_close=True).outcomes.collect()] == ["success"]


def test_report_text(spark):
    from linktrove.operators.report import task_report

    tasks = spark.createDataFrame([(1, "Read", "a\nb", ["x", "y"])], "id long, content string, description string, labels array<string>")
    attempts = spark.createDataFrame(
        [
            (1, 1, "u2", "youtube_playlist", None, "late", None, None, None, None, None),
            (1, 0, "u1", "webpage", "Body", None, "m", "https://b/x.PNG", "/v.mp4", "/m.md", None),
        ],
        ATTEMPT,
    )
    expected = (
        "## Read\n\n### Original Description\n> a\n> b\n\n### Labels\n`x`, `y`\n\n"
        "**Type**: Webpage  \n*Extraction Method: m*  \n  \n- [Video: 1 (Local)](/v.mp4)\n- [Markdown](/m.md)\n- [Image](https://b/x.PNG)\n\nBody\n\n"
        "**Type**: Youtube_playlist  \n**Error:** late\n[No content extracted]\n\n---\n"
    )
    assert [r.markdown for r in task_report(tasks, attempts).collect()] == [expected]
    parts = task_report(tasks, attempts, part_rows=1).orderBy("part").collect()
    assert len(parts) == 2 and "\n".join(r.markdown for r in parts) == expected


def test_scope_limit_and_labels(spark):
    tasks = spark.createDataFrame(
        [(1, 2, "", "", [], START + timedelta(1), 0), (2, 2, "", "", None, START, 1), (3, 2, "", "", [LABEL], None, 2), (4, 3, "", "", [], START, 3)], TASKS
    )
    projects = spark.createDataFrame([(3, "capture", 5), (2, "CAPTURE", 1)], "id long, name string, input_pos long")
    scope = K.capture_scope(tasks, projects)
    assert sorted(r.id for r in scope.collect()) == [1, 2, 3]
    assert [r.id for r in K.oldest_tasks(scope, 2).collect()] == [2, 1]
    assert K.oldest_tasks(scope, 0).count() == 3
    assert sorted(r.id for r in K.label_filter(scope).collect()) == [1, 2]
    assert {r.id: r.labels for r in K.label_append(scope).collect()} == {1: [LABEL], 2: [LABEL], 3: [LABEL]}
    assert K.capture_scope(tasks, projects, "other").count() == 0
    with pytest.raises(Exception, match="no project named"):
        K.capture_scope(tasks, projects, "other", require=True).collect()


def test_page_shapes_give_the_same_tasks(spark):
    items = ['{"id":"1","content":"a"}', '{"id":"2","content":"b"}']
    shapes = [
        [f'{{"results":[{",".join(items)}]}}'],
        [f'[{",".join(items)}]'],
        items,
        [f'[{{"results":[{items[0]}]}},{items[1]}]'],
        [f'[[{items[0]}],[{items[1]}]]'],
    ]
    for shape in shapes:
        raw = spark.createDataFrame(list(enumerate(shape)), "page_no long, raw string")
        got = flatten_pages(raw).orderBy("page_no", "item_no").select("item.id", "item.content").collect()
        assert [(r.id, r.content) for r in got] == [("1", "a"), ("2", "b")], shape
    typed = read_task_pages(spark.createDataFrame([(0, '{"id":"9","created_at":"2024-01-01T00:00:00Z"}')], "page_no long, raw string")).first()
    assert typed.id == 9 and typed.created_at == START and typed.labels == []


def test_retry_table(spark):
    log = spark.createDataFrame(
        [
            ("a", 1, False, "x", "other_error"), ("a", 2, True, None, None),
            ("b", 1, False, "x", "other_error"),
            ("c", 1, False, "no en", "language_unavailable"),
            ("d", 1, False, "x", "other_error"), ("d", 2, False, "y", "other_error"), ("d", 3, False, None, None),
        ],
        "k string, attempt int, success boolean, error string, reason string",
    )
    got = {r.k: (r.success, r.error, r.reason, r.retry) for r in O.retry_table(log, ["k"]).collect()}
    assert got == {
        "a": (True, None, None, False), "b": (False, "x", "other_error", True),
        "c": (False, "no en", "language_unavailable", False), "d": (False, "Maximum retries exceeded", "other_error", False),
    }


def test_notebook_hint_never_hides_a_notebook(spark):
    urls = [
        "https://github.com/o/r/blob/x.ipynb", "https://colab.research.google.com/x", "https://www.kaggle.com/u/notebooks",
        "https://nbviewer.jupyter.org/a.ipynb", "https://deepnote.com/x",
    ]
    df = spark.createDataFrame([(u, "") for u in urls], "content string, description string")
    assert K.notebook_gate(df).where(F.col("has_notebook")).count() == len(urls)
