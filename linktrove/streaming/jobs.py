"""Structured Streaming jobs on the same columns as the batch jobs."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linktrove.functions.text import as_utc, from_utc
from linktrove.operators import ledger as L
from linktrove.operators import logs
from linktrove.operators import tasks as K
from linktrove.plans.capture_run import gated_rows
from linktrove.sources import ledger as store
from linktrove.sources.scratch import materialize, scratch_scope


def stream_capture(
    tasks: DataFrame, ledger_root: str, checkpoint: str, attempts: DataFrame, once: bool = True, compact_every: int = 16,
) -> StreamingQuery:
    """Each micro-batch of tasks is gated against the ledger and appends its changes.

    The stream's first version follows all that the ledger held when its checkpoint
    began and is kept beside the checkpoint.  Batch N reads the versions before its
    own, first + N, and replaces only that one, so a batch that is delivered again
    gives the same ledger.  Of these it reads the buckets and rows of its own URLs.
    Every ``compact_every`` batches a snapshot of all earlier versions is written
    first, so a read takes that many folders at most.  Intermediate tables go when
    the batch's changes are stored.  ``attempts`` holds what trying a (task, url) gives.
    """
    spark = tasks.sparkSession
    base = store.base_version(spark, ledger_root, checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        version = base + batch_id
        if batch_id and batch_id % compact_every == 0:
            store.compact_ledger(spark, ledger_root, before=version)
        with scratch_scope(spark):
            # The rest of the batch runs in the outer session, where AQE may split hot keys.
            stored = K.notebook_gate(materialize(batch, "tasks", spark))
            rows = gated_rows(stored, lambda urls: store.read_ledger(spark, ledger_root, version, urls), attempts)
            changes = rows.where(F.col("action") == "try").withColumn("processed_at", F.col("created_at"))
            store.write_changes(L.latest_updates(changes, L.ORDER), ledger_root, version, replay=True)

    writer = tasks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need an instant; zone-free times hold UTC."""
    if stream.schema[ts].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn(ts, as_utc(F.col(ts)))
    return stream.withWatermark(ts, delay)


def stream_recent_dedup(urls: DataFrame, horizon: str, ts: str = "ts") -> DataFrame:
    """Drops a URL seen within the horizon."""
    return _with_event_time(urls, ts, horizon).dropDuplicatesWithinWatermark(["url"])


def stream_url_state(attempts: DataFrame, order: list[str]) -> DataFrame:
    """First success per URL over the whole stream; failures leave a URL open.

    Only successes can change the state "succeeded yet?" (one flag per URL), so
    failures never reach it, and each Arrow batch sends at most one success per
    URL: a hot URL arrives as a few rows.  For attempts without an event time; where
    there is one, :func:`stream_first_success` needs no Python and forgets old URLs.
    """
    columns = ["url", *order]
    wins = attempts.where("success").select(*columns)

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.sort_values(order, kind="stable").drop_duplicates("url")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for pdf in frames:
            first = pdf.sort_values(order, kind="stable").head(1)
            best = first if best is None else pd.concat([best, first]).sort_values(order, kind="stable").head(1)
        state.update((True,))
        yield best[columns]

    return wins.mapInPandas(combine, wins.schema).groupBy("url").applyInPandasWithState(
        step,
        outputStructType=wins.schema,
        stateStructType="done boolean",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def stream_first_success(
    attempts: DataFrame, order: list[str], limit: str = "365 days", delay: str = "1 day", ts: str = "ts",
) -> DataFrame:
    """First success per URL and span of ``limit``, as (url, span, *order), in update mode.

    Plain aggregate state on the JVM: successes are combined before the shuffle, so
    a hot URL arrives as a few rows, and a span's state goes when the watermark
    (``delay`` behind the newest time) has passed its end.  A success in a later span
    opens the URL's next row; one that comes after its span has closed is dropped.
    Read with :func:`read_first_success`.
    """
    wins = _with_event_time(attempts.select("url", "success", ts, *[c for c in order if c != ts]), ts, delay).where("success")
    kept = F.min(F.struct(*order)).alias("row")
    return wins.groupBy("url", F.window(ts, limit).alias("w")).agg(kept).select("url", F.col("w.start").alias("span"), "row.*")


def read_first_success(spark: SparkSession, root: str, order: list[str]) -> DataFrame:
    """Earliest success per URL of what :func:`write_updates` stored."""
    spans = read_updates(spark, root, ["url", "span"])
    return spans.groupBy("url").agg(F.min(F.struct(*order)).alias("row")).select("url", "row.*")


def stream_outcomes(ledger_rows: DataFrame, width: str = "1 day", delay: str = "1 day", ts: str = "processed_at") -> DataFrame:
    """Counts per tumbling window; rows later than the delay are dropped."""
    return (
        _with_event_time(ledger_rows, ts, delay)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("success").alias("successful"),
            F.count_if(~F.col("success")).alias("failed"),
        )
        .select(from_utc(F.col("w.start")).alias("window_start"), "total", "successful", "failed")
    )


def write_updates(stream: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Updated rows of a windowed stream, one folder per batch (replaced on replay)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/v={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_updates(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """Latest version of every key written by :func:`write_updates`."""
    log = spark.read.parquet(root)
    values = [c for c in log.columns if c not in (*keys, "v")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), "v").alias("row")).select(*keys, "row.*")


def append_files(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_log_filter(log_lines: DataFrame, ruleset: str = "app") -> DataFrame:
    """The batch noise rules on a stream of log lines; no state."""
    return logs.log_noise_filter(log_lines, ruleset)
