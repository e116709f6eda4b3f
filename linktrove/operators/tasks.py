"""Task selection: scope, order, labels and URL rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import urls as U


def capture_scope(tasks: DataFrame, projects: DataFrame, name: str = V.CAPTURE_PROJECT, require: bool = False) -> DataFrame:
    """Tasks of the first project whose lower-case name is ``name``.

    The project id is an aggregate of one row, so the semi join is a broadcast
    of a single id whatever the input size.  ``require`` makes a missing project
    an error (when the plan runs) instead of an empty result.
    """
    project = projects.where(F.lower("name") == name).agg(F.min_by("id", "input_pos").alias("project_id"))
    if require:
        missing = F.raise_error(F.lit(f"no project named {name!r}")).cast("bigint")
        project = project.select(F.coalesce("project_id", missing).alias("project_id"))
    return tasks.join(F.broadcast(project), "project_id", "left_semi")


def has_label(labels: Column, label: str = V.NOT_SCRAPEABLE) -> Column:
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


def label_filter(tasks: DataFrame, label: str = V.NOT_SCRAPEABLE) -> DataFrame:
    """Tasks without the label."""
    return tasks.where(~has_label(F.col("labels"), label))


def with_label(labels: Column, label: str = V.NOT_SCRAPEABLE) -> Column:
    current = F.coalesce(labels, F.array().cast("array<string>"))
    return F.when(F.array_contains(current, label), current).otherwise(F.array_append(current, F.lit(label)))


def label_append(tasks: DataFrame, label: str = V.NOT_SCRAPEABLE) -> DataFrame:
    return tasks.withColumn("labels", with_label(F.col("labels"), label))


def oldest_tasks(tasks: DataFrame, max_tasks: int | None = None) -> DataFrame:
    """Oldest first, input order on ties; ``None`` or 0 means all.

    Without a limit nothing is sorted here: the order is carried by the columns
    and every later step orders by key.
    """
    if not max_tasks:
        return tasks
    return tasks.orderBy(F.col("created_at").asc_nulls_last(), "input_pos").limit(max_tasks)


def task_url_array(content: Column, description: Column) -> Column:
    return U.extract_urls(content, description)


def extract_task_urls(tasks: DataFrame) -> DataFrame:
    """One row per (task, URL) in first-seen order, routed and with ids. No shuffle."""
    rows = tasks.select(
        F.col("id").alias("task_id"),
        "created_at",
        F.posexplode(task_url_array(F.col("content"), F.col("description"))).alias("pos", "url"),
    )
    url = F.col("url")
    return rows.select(
        "task_id", "created_at", "pos", "url",
        U.url_kind(url).alias("kind"),
        U.video_id(url).alias("video_id"),
        U.playlist_id(url).alias("playlist_id"),
        U.tweet_id(url).alias("tweet_id"),
    )


def notebook_gate(tasks: DataFrame) -> DataFrame:
    """Tasks with a ``has_notebook`` flag, from the task's own text (no shuffle).

    URLs are only extracted from texts that name a notebook host at all.
    """
    hint = F.concat_ws(" ", "content", "description").rlike(V.NOTEBOOK_HINT)
    found = task_url_array(F.col("content"), F.col("description"))
    return tasks.withColumn("has_notebook", F.when(hint, F.exists(found, U.is_notebook)).otherwise(F.lit(False)))
