"""Ledger joins: what is new, what was tried, and the merged ledger.

A URL may occur in a large share of all tasks.  Nothing here orders or collects
the rows of one URL in a window: each decision is an aggregate (combined before
the shuffle) joined back, and the join keeps the big side on the side AQE can
split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ["created_at", "task_id", "pos"]


def unseen_urls(task_urls: DataFrame, ledger: DataFrame) -> DataFrame:
    """URL rows not yet successful in the ledger; failed URLs stay."""
    done = ledger.where("success").select("url")
    return task_urls.where(F.col("url").isNotNull()).join(done, "url", "left_anti")


def latest_updates(updates: DataFrame, seq: list[str]) -> DataFrame:
    """Last update per url."""
    return updates.groupBy("url").agg(
        F.max_by(F.struct("task_id", "processed_at", "success"), F.struct(*seq)).alias("row")
    ).select("url", "row.*")


def ledger_upsert(ledger: DataFrame, updates: DataFrame, seq: list[str]) -> DataFrame:
    """Ledger after the updates, last write wins: one union and one aggregate."""
    columns = ["url", "task_id", "processed_at", "success"]
    old = ledger.select(*columns, F.lit(0).alias("_new"), *[F.lit(None).alias(f"_s{i}") for i in range(len(seq))])
    new = updates.select(*columns, F.lit(1).alias("_new"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(seq)])
    return latest_updates(old.unionByName(new), ["_new"] + [f"_s{i}" for i in range(len(seq))])


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def attempt_gate(attempts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mark attempts a sequential run would skip, as ``ledger_skip``.

    A row is skipped when its URL is successful in the ledger, or succeeded in
    an earlier row of this run.  Both are folded into one row per URL: "blocked
    from this position on" (from the start, for ledger successes).
    """
    position = F.struct(*ORDER)
    start = F.struct(*[F.lit(None).cast(attempts.schema[c].dataType).alias(c) for c in ORDER])
    in_run = attempts.where("success").groupBy("url").agg(F.min(position).alias("since"))
    in_ledger = ledger.where("success").select("url", start.alias("since"))
    # NULL fields sort first, so a ledger success is before every position.
    blocked = in_run.unionByName(in_ledger).groupBy("url").agg(F.min("since").alias("since"))
    return (
        attempts.join(blocked, "url", "left")
        .withColumn("ledger_skip", F.coalesce(F.col("since") < position, F.lit(False)))
        .drop("since")
    )


def video_dedup(rows: DataFrame) -> DataFrame:
    """Mark the second and later rows of a video within a task, as ``duplicate``.

    Expects rows that passed the ledger check; rows without a video id are
    never duplicates.
    """
    first = (
        rows.where(F.col("video_id").isNotNull())
        .groupBy("task_id", "video_id")
        .agg(F.min("pos").alias("_first"))
    )
    return (
        rows.join(first, ["task_id", "video_id"], "left")
        .withColumn("duplicate", F.coalesce(F.col("pos") > F.col("_first"), F.lit(False)))
        .drop("_first")
    )


def gate_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """``action`` per row: ``ledger_skip``, ``duplicate`` or ``try``.

    Use where attempts are recorded outcomes (a row that was never tried has a
    NULL ``success``).  Where an outcome is supplied for every row and several
    URLs name the same video, use :func:`linktrove.operators.aliases.gate_with_aliases`.
    """
    gated = attempt_gate(rows, ledger)
    first = (
        gated.where(~F.col("ledger_skip") & F.col("video_id").isNotNull())
        .groupBy("task_id", "video_id")
        .agg(F.min("pos").alias("_first"))
    )
    action = (
        F.when(F.col("ledger_skip"), "ledger_skip")
        .when(F.col("pos") > F.col("_first"), "duplicate")
        .otherwise("try")
    )
    return (
        gated.join(first, ["task_id", "video_id"], "left")
        .withColumn("action", action)
        .drop("_first", "ledger_skip")
    )
