"""Attempt classes, task status and run counters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.operators.tasks import has_label, with_label


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_ok(content: Column, error: Column) -> Column:
    content, error = _text(content), _text(error)
    return (
        (content != "")
        & (error == "")
        & ~content.startswith(V.EXTRACT_ERROR_PREFIX)
        & ~content.startswith(V.SUMMARY_ERROR_PREFIX)
        & ~content.contains(V.MODEL_CALL_ERROR)
    )


def error_class(content: Column, error: Column) -> Column:
    """``ok``, ``llm_error``, ``extract_error`` or ``no_content``; NULL text counts as empty."""
    c, e = _text(content), _text(error)
    model_failed = (
        c.startswith(V.SUMMARY_ERROR_PREFIX) | c.contains(V.MODEL_CALL_ERROR) | e.contains(V.MODEL_CALL_ERROR)
    )
    return (
        F.when(is_ok(content, error), "ok")
        .when(model_failed, "llm_error")
        .when(c.startswith(V.EXTRACT_ERROR_PREFIX) | (e != ""), "extract_error")
        .otherwise("no_content")
    )


def hidden_summary_error(content: Column) -> Column:
    """Summary failure inside a longer block, which the prefix rules do not see."""
    c = _text(content)
    return c.contains(V.SUMMARY_ERROR_PREFIX) & ~c.startswith(V.SUMMARY_ERROR_PREFIX)


def fails_task(content: Column, error: Column) -> Column:
    """An attempt with an error that comes from the model call."""
    c, e = _text(content), _text(error)
    return (e != "") & (c.startswith(V.SUMMARY_ERROR_PREFIX) | e.contains(V.MODEL_CALL_ERROR))


def fails_counter(content: Column, error: Column) -> Column:
    """Model error text, with or without an error: the task counts as failed."""
    return _text(content).startswith(V.SUMMARY_ERROR_PREFIX) | _text(error).contains(V.MODEL_CALL_ERROR)


def extract_failed(content: Column) -> Column:
    return _text(content).startswith(V.EXTRACT_ERROR_PREFIX)


def task_outcome(tasks: DataFrame, rows: DataFrame, no_close: bool = False) -> DataFrame:
    """Status per task from its gated URL rows.

    ``tasks``: id, labels, has_notebook.  ``rows``: task_id, action, content,
    error.  The fold is plain counting, so it is combined before the shuffle.
    """
    tried = F.col("action") == "try"
    content, error = F.col("content"), F.col("error")
    folded = rows.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count_if(F.col("action") == "ledger_skip").alias("n_skip"),
        F.count_if(tried).alias("n_tried"),
        F.count_if(tried & is_ok(content, error)).alias("n_ok"),
        F.count_if(tried & fails_task(content, error)).alias("n_model"),
        F.count_if(tried & extract_failed(content)).alias("n_extract"),
        F.count_if(tried & fails_counter(content, error)).alias("n_counter"),
    )
    joined = tasks.join(folded, tasks["id"] == folded["task_id"], "left").drop("task_id")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_urls", "n_skip", "n_tried", "n_ok", "n_model", "n_extract", "n_counter")}
    n_new = n["n_urls"] - n["n_skip"]
    labelled, notebook = has_label(F.col("labels")), F.coalesce(F.col("has_notebook"), F.lit(False))
    all_seen = (n_new == 0) & (n["n_skip"] > 0)
    failed = (~all_seen & (n["n_ok"] == 0)) | (n["n_model"] > 0) | (n["n_extract"] > 0)
    status = (
        F.when(labelled | notebook, "skipped")
        .when(failed, "failed")
        .otherwise("success" if no_close else "closed")
    )
    done = status.isin("success", "closed")
    counted = ~labelled & ~notebook
    return joined.select(
        F.col("id").alias("task_id"),
        status.alias("status"),
        (notebook & ~labelled).alias("notebook_skip"),
        F.when((notebook & ~labelled) | (status == "failed"), with_label(F.col("labels")))
        .otherwise(F.col("labels")).alias("labels"),
        F.when(counted, n_new).otherwise(F.lit(0)).alias("n_new"),
        F.when(counted, n["n_skip"]).otherwise(F.lit(0)).alias("n_skip"),
        F.when(done & (n["n_counter"] > 0), "failed")
        .when(done, "successful").otherwise(status).alias("counted_as"),
        (done & (n["n_counter"] == 0) & (n["n_tried"] > 0)).alias("in_report"),
    )


def outcome_counters() -> list[Column]:
    """Aggregates over task outcomes; gathered while they are written, see ``materialize_counted``."""
    return [
        F.count(F.lit(1)).alias("tasks_to_process"),
        F.count_if(F.col("counted_as") == "successful").alias("successful_tasks"),
        F.count_if(F.col("counted_as") == "failed").alias("failed_tasks"),
        F.count_if(F.col("counted_as") == "skipped").alias("skipped_tasks"),
        F.count_if("notebook_skip").alias("notebook_tasks_skipped"),
        F.count_if(F.col("status") == "closed").alias("_closed"),
        F.coalesce(F.sum("n_skip"), F.lit(0)).alias("skipped_urls"),
        F.coalesce(F.sum("n_new"), F.lit(0)).alias("processed_urls"),
    ]


def run_summary(scope: DataFrame, counted: dict[str, int]) -> DataFrame:
    """The nine run counters, one row.

    A notebook task counts both as notebook-skipped and as skipped.
    ``scope`` is one row per task of the project before the limit; ``counted``
    holds the :func:`outcome_counters` of the stored outcomes (absent: 0).
    """
    n = {name: F.lit(counted.get(name) or 0).cast("long") for name in (
        "tasks_to_process", "successful_tasks", "failed_tasks", "skipped_tasks", "notebook_tasks_skipped", "skipped_urls", "processed_urls")}
    closed = F.lit(counted.get("_closed") or 0).cast("long")
    considered = scope.agg(F.count(F.lit(1)).alias("total_tasks_considered"))
    return considered.select(
        *[c.alias(name) for name, c in n.items()], "total_tasks_considered",
        (F.col("total_tasks_considered") - closed).alias("tasks_remaining_in_capture"),
    )


def batch_summary(results: DataFrame, key: str, success: str = "success", batches: DataFrame | None = None) -> DataFrame:
    """Counts per batch; a batch without results is no success.

    ``batches``: one row per batch (column ``key``), so that an empty one has its row.
    """
    counts = results.groupBy(key).agg(
        F.count(success).alias("total"),
        F.count_if(success).alias("successful"),
        F.count_if(~F.col(success)).alias("failed"),
    )
    if batches is not None:
        known = batches.select(key).distinct().withColumnRenamed(key, "_batch")
        counts = known.join(counts, F.col("_batch").eqNullSafe(F.col(key)), "full").select(
            F.coalesce(key, "_batch").alias(key), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "successful", "failed")]
        )
    return counts.withColumn("success", F.col("total") > 0)


def retry_table(log: DataFrame, keys: list[str], max_attempts: int = V.TRANSCRIPT_ATTEMPTS) -> DataFrame:
    """Latest state per request of an attempt log, with bounded retries.

    ``log``: keys, attempt, success, error, reason.  ``language_unavailable`` is
    final; any other failure may be retried while attempts are left.
    """
    last = F.max_by(F.struct("success", "error", "reason"), "attempt")
    state = log.groupBy(*keys).agg(
        last.alias("last"), F.count(F.lit(1)).alias("attempts"), F.max("success").alias("success")
    )
    final = F.col("last.reason") == "language_unavailable"
    return state.select(
        *keys,
        "attempts",
        "success",
        F.when(~F.col("success"), F.coalesce("last.error", F.lit(V.RETRIES_EXCEEDED))).alias("error"),
        F.when(F.col("success"), F.lit(None))
        .when(final, "language_unavailable").otherwise("other_error").alias("reason"),
        (~F.col("success") & ~F.coalesce(final, F.lit(False)) & (F.col("attempts") < max_attempts)).alias("retry"),
    )
