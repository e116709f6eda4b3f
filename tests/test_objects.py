"""Artifacts as single named objects."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linktrove.sources import objects

ROW = "ts timestamp_ntz, filename string, content string, key string, n int"
DAY = datetime(2024, 12, 30)


def test_names_read_back_exactly(spark, tmp_path):
    rows = [(DAY, "a.txt", "one"), (DAY, "a.txt", "two"), (datetime(2024, 1, 1), "a.txt", "other week"), (DAY, "b", "no ending"), (DAY, "b", "twice"),
            (DAY, None, "nameless"), (DAY, None, "nameless too"), (DAY, "", "empty name"), (DAY, "é $1 x.tar.gz", "odd"), (DAY, "n.txt", None),
            (DAY, "c.txt", "x\r\ny\n"), (DAY, "same.txt", "same"), (DAY, "same.txt", "same")]
    root = str(tmp_path / "out")
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROW).repartition(4)
    objects.write_objects(table, root)
    manifest = objects.object_manifest(spark, root).collect()
    content = {r.key: bytes(r.content).decode() for r in objects.read_objects(spark, root).collect()}
    got = sorted(((r.filename, content[r.key]) for r in manifest), key=repr)
    assert got == sorted(((n, c or "") for _, n, c in rows), key=repr)
    assert content["2025/week_01/c.txt"] == "x\r\ny\n" and content["2024/week_01/a.txt"] == "other week"
    assert {r.key[:15] for r in manifest if r.filename == "a.txt" and r.shared} == {"2025/week_01/a~"} and sum(r.key.count("~") for r in manifest) == 6
    assert {(r.filename, r.n) for r in objects.repeated_names(spark, root).collect()} == {("a.txt", 2), ("b", 2), ("same.txt", 2)}
    files = [f for _, _, names in os.walk(f"{root}/objects") for f in names]
    assert len(files) == len(set(r.key for r in manifest)) and not any(f.startswith(".") for f in files)
    objects.write_objects(table.where("filename = 'c.txt'").withColumn("content", F.lit("newer")), root)
    assert {bytes(r.content) for r in objects.read_objects(spark, root).where("key = '2025/week_01/c.txt'").collect()} == {b"newer"}


def test_a_failed_job_commits_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    table = spark.range(20).selectExpr("timestamp_ntz'2024-01-01 00:00:00' AS ts", "'f' || id AS filename", "'x' AS content", "id")
    objects.write_objects(table.where("id < 3"), root)
    bad = table.withColumn("content", F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        objects.write_objects(bad.repartition(4), root)
    assert sorted(r.key for r in objects.object_manifest(spark, root).collect()) == [f"2024/week_01/f{k}" for k in range(3)]
