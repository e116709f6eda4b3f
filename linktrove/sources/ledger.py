"""Ledger store: an append-only change log of Parquet folders, cut by a hash of the URL.

Layout under one root::

    kind=log/v=<N>/b=<bucket>/     changes of run or batch N, overwritten only by its own replay
    kind=snap/v=<N>/b=<bucket>/    snapshot: the merged ledger up to and including version N

A small batch only writes its own folder, and only the buckets it has URLs in.
A read takes the newest finished snapshot up to the asked version and the
versions after it as one table, one scan whatever their number.  A reader that
names the URLs it asks for reads their buckets only (the buckets reach the scan
as a dynamic partition filter) and groups the rows of these URLs only.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktrove import schemas

_COLUMNS = ["url", "task_id", "processed_at", "success"]
_STORED = schemas.LEDGER + ", kind STRING, v BIGINT, b INT"
#: Part of the layout: a ledger is read with the number it was written with.
BUCKETS = 64


def bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def _folder(root: str, kind: str, version: int) -> str:
    return f"{root}/kind={kind}/v={version}"


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the finished (``_SUCCESS``) folders; only folder names are listed."""
    fs, path = _files(spark, f"{root}/kind={kind}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(n for n in found if fs.exists(_files(spark, f"{_folder(root, kind, n)}/_SUCCESS")[1]))


def next_version(spark: SparkSession, root: str) -> int:
    return max(_versions(spark, root, "log") + _versions(spark, root, "snap"), default=-1) + 1


def _write(df: DataFrame, path: str, mode: str) -> None:
    cut = df.select(*_COLUMNS, bucket(F.col("url")).alias("b"))
    # a bucket may hold many rows: AQE splits it, and joins small ones to one task
    cut.hint("rebalance", "b").sortWithinPartitions("b", "url").write.mode(mode).partitionBy("b").parquet(path)


def write_changes(df: DataFrame, root: str, version: int, replay: bool = False) -> None:
    """Changes of one run; at most one row per url.

    A version that exists is an error, so two runs cannot take one number; only a
    caller that owns the number may ``replay`` it.
    """
    _write(df, _folder(root, "log", version), "overwrite" if replay else "errorifexists")


def base_version(spark: SparkSession, root: str, checkpoint: str) -> int:
    """First version of a stream: behind all that the ledger held when its checkpoint began."""
    path = f"{checkpoint.rstrip('/')}-base"
    fs, mark = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(mark):
        first = max(1, next_version(spark, root))
        spark.range(1).select(F.lit(first).alias("base")).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["base"]


def _usable(spark: SparkSession, root: str, before: int | None) -> tuple[int, list[str]]:
    """Newest usable snapshot (-1 without one) and the folders a read takes."""
    def known(kind: str) -> list[int]:
        return [n for n in _versions(spark, root, kind) if before is None or n < before]

    snapshot = max(known("snap"), default=-1)
    folders = [_folder(root, "log", n) for n in known("log") if n > snapshot]
    return snapshot, ([_folder(root, "snap", snapshot)] if snapshot >= 0 else []) + folders


def read_ledger(spark: SparkSession, root: str, before: int | None = None, urls: DataFrame | None = None) -> DataFrame:
    """Latest row per url, over versions below ``before`` (all when None).

    ``urls``: only the rows of these URLs (column ``url``); other buckets are not read.
    """
    _, folders = _usable(spark, root, before)
    if not folders:
        return spark.createDataFrame([], schemas.LEDGER)
    log = spark.read.schema(_STORED).option("basePath", root).parquet(*folders)
    if urls is not None:
        asked = urls.where(F.col("url").isNotNull()).select("url").distinct()
        # at most BUCKETS rows; the comparison marks them as a filter worth pruning by
        buckets = asked.select(bucket(F.col("url")).alias("b")).distinct().where(F.col("b") >= 0)
        log = log.join(F.broadcast(buckets), "b", "left_semi").join(asked, "url", "left_semi")
    if len(folders) == 1:
        return log.select(*_COLUMNS)
    latest = log.groupBy("url").agg(F.max_by(F.struct("task_id", "processed_at", "success"), "v").alias("row"))
    return latest.select("url", "row.*")


def compact_ledger(spark: SparkSession, root: str, before: int | None = None) -> int:
    """Write a snapshot of everything below ``before``; returns its number (-1 for an empty ledger)."""
    latest = max((n for kind in ("log", "snap") for n in _versions(spark, root, kind) if before is None or n < before), default=-1)
    if latest >= 0 and latest not in _versions(spark, root, "snap"):
        _write(read_ledger(spark, root, latest + 1), _folder(root, "snap", latest), "overwrite")
    return latest


def drop_compacted(spark: SparkSession, root: str, keep: int = 1) -> list[int]:
    """Remove log and snapshot folders that the newest ``keep`` snapshots do not need; returns their versions."""
    snapshots = _versions(spark, root, "snap")
    if len(snapshots) < keep:
        return []
    oldest = snapshots[-keep]
    gone = [("snap", n) for n in snapshots if n < oldest] + [("log", n) for n in _versions(spark, root, "log") if n <= oldest]
    for kind, n in gone:
        fs, path = _files(spark, _folder(root, kind, n))
        fs.delete(path, True)
    return sorted({n for _, n in gone})
