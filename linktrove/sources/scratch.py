"""Shared scratch folder for intermediate tables and checkpoints."""

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OPEN = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; set here only in local mode when unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="linktrove-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/linktrove/{name}-{uuid.uuid4().hex}"
    for folders in getattr(_OPEN, "scopes", []):
        folders.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside (by this thread) are removed at the end.

    For work whose result is stored elsewhere by then, such as a micro-batch.
    """
    folders: list[str] = []
    _OPEN.scopes = [*getattr(_OPEN, "scopes", []), folders]
    try:
        yield
    finally:
        _OPEN.scopes = [s for s in _OPEN.scopes if s is not folders]
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write once as Parquet and read back: columnar, and safe when executors are lost.

    ``spark``: session to read with, when it is not the session of ``df``.
    """
    spark = spark or df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, *counters: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize` and aggregates gathered by the same write, without a second pass.

    A table without rows may be planned away with its counters; they are absent then.
    """
    seen = Observation(name)
    stored = materialize(df.observe(seen, *counters), name)
    return stored, dict(seen.get)
