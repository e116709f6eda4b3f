"""Artifacts as single named objects: a Python data source with a two-phase commit.

Each row becomes one object ``year/week_NN/filename`` below ``<root>/objects``.
Tasks write whole objects (under a private name, then renamed, so none is ever
seen half written) and one manifest each.  The job's commit lists the manifests of
its successful tasks in one small file; what no commit lists is not read.  A
replayed or repeated job writes the same keys again, as a plain store does.

A filename that several rows of a job share in its week would lose all but one:
each of these rows is stored as ``stem~<digest of content><ending>`` and reported
by :func:`repeated_names`.  Rows without a filename are ``unnamed-<digest>``.  The
name as it was given stays in the manifest.

Paths are those of ``pyarrow.fs`` (local and shared folders, object stores), and
must mean the same place on every executor.
"""

import json
import posixpath
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from linktrove.sources.sinks import artifact_keys

# tasks get these classes whole, so that workers need not import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "artifact_objects"
_MANIFEST = pa.schema([("job", pa.string()), ("task", pa.string()), ("key", pa.string()), ("filename", pa.string()), ("shared", pa.bool_()),
                       ("bytes", pa.int64())])
COLUMNS = "key STRING, filename STRING, shared BOOLEAN, content BINARY"


class TaskDone(WriterCommitMessage):
    def __init__(self, task: str, objects: int):
        self.task, self.objects = task, objects


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskDone:
        store, root = self._open()
        task, rows, folders = uuid.uuid4().hex, [], set()
        for batch in iterator:
            for key, filename, shared, content in zip(*(batch.column(c) for c in ("key", "filename", "shared", "content"))):
                path = f"{root}/objects/{key.as_py()}"
                folder = posixpath.dirname(path)
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                data = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                waiting = f"{folder}/.{task}"
                with store.open_output_stream(waiting) as out:
                    out.write(data)
                store.move(waiting, path)
                rows.append((self.job, task, key.as_py(), filename.as_py(), shared.as_py(), data.size))
        if rows:
            store.create_dir(f"{root}/manifests", recursive=True)
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MANIFEST)], schema=_MANIFEST)
            pq.write_table(table, f"{root}/manifests/{self.job}-{task}.parquet", filesystem=store)
        return TaskDone(task, len(rows))

    def commit(self, messages: list[TaskDone | None]) -> None:
        store, root = self._open()
        store.create_dir(f"{root}/commits", recursive=True)
        lines = [json.dumps({"job": self.job, "task": m.task, "objects": m.objects}) for m in messages if m is not None and m.objects]
        with store.open_output_stream(f"{root}/commits/{self.job}.json") as out:
            out.write("".join(line + "\n" for line in lines).encode())

    def abort(self, messages: list[TaskDone | None]) -> None:
        """Without a commit no manifest of the job counts; those of finished tasks are removed."""
        store, root = self._open()
        for m in messages:
            if m is not None and m.objects:
                store.delete_file(f"{root}/manifests/{self.job}-{m.task}.parquet")


class ArtifactObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are replaced by name; use mode append")
        return ObjectWriter(self.options["path"])


def object_rows(df: DataFrame, ts: str = "ts", filename: str = "filename", content: str = "content") -> DataFrame:
    """(key, filename, shared, content) as :func:`write_objects` stores them; equal rows are one object."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    given = F.nullif(F.col(filename), F.lit(""))
    digest = F.substring(F.sha2(data, 256), 1, 16)
    rows = df.select(F.col(ts).alias("ts"), F.col(filename).alias("filename"), given.alias("given"), digest.alias("digest"), data.alias("content"))
    # one row per (week, name, content), then the names that several contents share: counted without their contents
    keyed = artifact_keys(rows.withColumn("name", F.coalesce("given", F.concat(F.lit("unnamed-"), "digest"))), filename="name").drop(
        "folder", "iso_year", "iso_week", "ts")
    uses = keyed.where(F.col("given").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("many"))
    met = keyed.join(uses, F.col("key") == F.col("many"), "left")
    shared = F.col("many").isNotNull()
    apart = F.regexp_replace("key", r"(?s)^(.*?[^/])(\.[^./]*)?$", F.concat(F.lit("$1~"), F.col("digest"), F.lit("$2")))
    return met.select(F.when(shared, apart).otherwise(F.col("key")).alias("key"), "filename", shared.alias("shared"), "content")


def write_objects(df: DataFrame, root: str, ts: str = "ts", filename: str = "filename", content: str = "content") -> None:
    """One object per row of (ts, filename, content)."""
    df.sparkSession.dataSource.register(ArtifactObjects)
    object_rows(df, ts, filename, content).write.format(NAME).mode("append").save(root)


def object_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(key, filename, shared, bytes) of the committed objects, a row for each written row."""
    commits = spark.read.schema("job STRING, task STRING, objects BIGINT").json(f"{root}/commits")
    rows = spark.read.schema("job STRING, task STRING, key STRING, filename STRING, shared BOOLEAN, bytes BIGINT").parquet(f"{root}/manifests")
    return rows.join(commits.select("job", "task"), ["job", "task"], "left_semi").drop("job", "task")


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of the committed objects."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/objects")
    found = files.select(F.element_at(F.split("path", "/objects/"), -1).alias("key"), "content")
    # Spark's file reader passes over empty files
    keys = object_manifest(spark, root).select("key").distinct()
    return keys.join(found, "key", "left").select("key", F.coalesce("content", F.lit(b"")).alias("content"))


def repeated_names(spark: SparkSession, root: str) -> DataFrame:
    """(filename, n): names that several rows of a job shared in a week."""
    return object_manifest(spark, root).where("shared").groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
