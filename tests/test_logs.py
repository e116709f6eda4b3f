import random

import pytest
from pyspark.sql import functions as F

from linktrove.operators import logs, winnowing

APP = [
    ("main", "INFO", "Could not convert TeX math x", False),
    ("main", "INFO", "monaco loaded", True),
    ("main", "WARNING", "Monaco loaded", False),
    ("main", "ERROR", "[vs/base] x", False),
    ("main", "INFO", "HTTP Request: GET HTTP/1.1 200 OK", False),
    ("main", "INFO", "HTTP Request: GET HTTP/1.1 404", True),
    ("main", "INFO", "api/show HTTP/1.1 200", False),
    ("main", "INFO", "api/show HTTP/1.1 500", True),
    ("main", "DEBUG", "x", False),
    ("urllib3.pool", "INFO", "x", False),
    ("urllib3", "WARNING", "x", True),
    ("playwright.browser.console", "WARNING", "x", False),
    ("playwright.browser.console", "ERROR", "x", True),
    ("playwright", "WARNING", "x", True),
    ("main", "INFO", None, True),
]


def test_app_rules(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(APP)], "i int, logger string, level string, message string")
    kept = {r.i for r in logs.log_noise_filter(df).collect()}
    assert kept == {i for i, r in enumerate(APP) if r[3]}


@pytest.mark.parametrize("level, message, noise", [
    ("INFO", "HTTP Request: GET HTTP/1.1 302", True),
    ("INFO", "HTTP Request: GET HTTP/1.1 503", False),
    ("WARNING", "failed to load x", True),
    ("ERROR", "failed to load x", False),
    ("INFO", "api/generate HTTP/1.1 200", True),
])
def test_scraper_rules(one, level, message, noise):
    assert one(lambda m, v: logs.log_noise(m, v, "scraper"), m=message, v=level) is noise


def test_console_rules(spark):
    rows = [("error", "out of memory", True), ("ERROR", "worker crashed", True), ("error", "status of 404", False), ("warning", "out of memory", False),
            ("error", "Loading x", False), ("error", "scrollbar gone", False), ("error", "", False), ("error", "a.b*c", True)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, type string, message string")
    assert {r.i for r in logs.console_filter(df).collect()} == {i for i, r in enumerate(rows) if r[2]}


def test_rule_table(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["abc def", "a+b", "xxabcdefghijxx", "é😀z", "", "nothing"])], "i int, t string")
    rules = spark.createDataFrame([("c d",), ("a+b",), ("abcdefghij",), ("😀z",), ("",), ("abcdefghik",)], "phrase string")
    assert {r.i for r in logs.apply_rules(texts, "t", rules).collect()} == {0, 1, 2, 3}
    assert logs.apply_rules(texts, "t", rules.where(F.lit(False))).count() == 0


def test_rules_judge_rows_not_keys(spark):
    texts = spark.createDataFrame([(1, "a needle"), (1, "nothing"), (None, "needle"), (1, "a needle"), (2, None)], "i int, t string")
    rules = spark.createDataFrame([("needle",), ("https://a.example/x",), ("https://a.example/y",), (None,)], "phrase string")
    assert sorted(map(repr, map(tuple, logs.apply_rules(texts, "t", rules).collect()))) == ["(1, 'a needle')"] * 2 + ["(None, 'needle')"]


def test_rules_of_all_lengths_equal_a_plain_search(spark):
    rng = random.Random(3)
    words = ["ab", "Abc", "é", "日本語", "x.y", "the ", "  ", "%", "\\", "zz", "\n", "q"]
    draw = lambda n: "".join(rng.choice(words) for _ in range(n))
    texts = [draw(rng.randint(0, 60)) for _ in range(150)] + ["", None, "a" * 5000 + "needle" + "a" * 5000]
    phrases = {draw(rng.randint(1, 3)) + str(k) for k in range(20)} | {"needle", "aaneedleaa", "a" * 40, "é", "", None}
    for size in (4, 7, 8, 9, 15, 16, 17, 30, 47, 48, 49, 60):
        whole = rng.choice([t for t in texts if t and len(t) > 80])
        at = rng.randint(0, len(whole) - size)
        phrases |= {whole[at:at + size], whole[at:at + size - 1] + "!"}
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "i int, t string, _n int")
    for part in (phrases, {p for p in phrases if p and len(p) < 8}, {p for p in phrases if p and len(p) >= 8}, {p for p in phrases if p and len(p) > 48}):
        rules = spark.createDataFrame([(p,) for p in part], "phrase string")
        want = [k for k, t in enumerate(texts) if t is not None and any(p and p in t for p in part)]
        assert sorted(r.i for r in logs.apply_rules(table, "t", rules).collect()) == want


def test_kept_pieces_are_shared_and_few():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    for size, (k, w) in winnowing.GUARANTEES.items():
        kept = set(winnowing.kept_pieces(text, k, w).tolist())
        assert len(kept) < 2.5 * len(text) / (w + 1)
        assert all(kept & set(winnowing.kept_pieces(text[at:at + size], k, w).tolist()) for at in range(0, len(text) - size, 37))
        assert not len(winnowing.kept_pieces(text[:size - 1], k, w))
