"""Ledger check and per-task video check together, for URLs that share a video.

A task tries, for each video, the first of its URLs that has not succeeded
before; a try may make a URL succeed for later tasks.  So where a task holds
several URLs of one video, what it tries depends on when the others succeeded.

Instead of walking rows in order, the time of each URL's first success is
narrowed from both sides.  ``hi`` counts only tries that are certain, ``lo``
all that are still possible.  A URL left with one open try that waits for one
other URL is a link: its first success is one of two times, by whether the
other's comes before a limit.  Two such steps make one of the same form, so
links are joined with themselves and chains of n tasks settle after log n
joins (path doubling).  URLs with more open tries take part in the next round,
which starts from the narrowed bounds; the earliest open row is always decided
by it, so the bounds meet.  Rows of tasks with one URL of a video (nearly all)
are certain from the start and take no part, and a round holds only the videos
that still have an open URL.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktrove.sources.scratch import materialize

TASK_ORDER = ["created_at", "task_id"]


def _before(time: Column, limit: Column) -> Column:
    """NULL is never."""
    return F.coalesce(time < limit, F.lit(False))


def _links(several: DataFrame, bounds: DataFrame) -> DataFrame:
    """One round: (url, first, lo, hi, need, at, early, late) from bounds (url, first, lo, hi).

    ``need`` set: the first success is ``early`` if that of ``need`` is before ``at``, else ``late``.
    """
    # A window over the URLs of one video in one task: bounded by the task's own text.
    earlier = Window.partitionBy("group_id", "task_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    open_ = ~_before(F.col("hi"), F.col("at"))
    dead = ~_before(F.col("lo"), F.col("at"))
    judged = several.join(bounds.select("url", "lo", "hi"), "url").select(
        "url", "at", "success", F.col("hi").alias("known"),
        F.coalesce(F.sum(open_.cast("int")).over(earlier), F.lit(0)).alias("n_open"),
        F.coalesce(F.sum(dead.cast("int")).over(earlier), F.lit(0)).alias("n_dead"),
        F.max(F.when(open_, F.col("url"))).over(earlier).alias("need"),
    )
    waits = F.col("n_open") > 0
    tries = judged.where("success AND n_dead = 0 AND coalesce(at < known, true)").groupBy("url").agg(
        F.min("at").alias("possible_at"), F.min(F.when(~waits, F.col("at"))).alias("certain_at"),
        F.min(F.when(waits, F.struct("at", "n_open", "need"))).alias("wait"), F.max(F.when(waits, F.col("at"))).alias("last_wait"),
    )
    narrowed = bounds.join(tries, "url", "left").select(
        "url", "first", F.least("hi", "possible_at").alias("lo"), F.least("hi", "certain_at").alias("hi"), "wait", "last_wait"
    )
    single = (F.col("wait.at") == F.col("last_wait")) & (F.col("wait.n_open") == 1) & ~F.col("lo").eqNullSafe(F.col("hi"))
    return narrowed.select(
        "url", "first", "lo", "hi", F.when(single, F.col("wait.need")).alias("need"), F.col("wait.at").alias("at"),
        F.col("wait.at").alias("early"), F.col("hi").alias("late"),
    )


def _doubled(links: DataFrame) -> DataFrame:
    """Every link joined to what it waits for: a link of the other's need, or a known time."""
    to = links.select(
        F.col("url").alias("to_url"), F.col("need").alias("to_need"), F.col("at").alias("to_at"), F.col("early").alias("to_early"),
        F.col("late").alias("to_late"), F.col("lo").alias("to_lo"), F.col("hi").alias("to_hi"),
    )

    def then(time: str) -> Column:
        return F.when(_before(F.col(time), F.col("at")), F.col("early")).otherwise(F.col("late"))

    met = links.join(to, F.col("need") == F.col("to_url"), "left")
    on = F.col("to_need").isNotNull()
    early = F.when(on, then("to_early")).otherwise(then("to_lo"))
    late = F.when(on, then("to_late")).otherwise(then("to_hi"))
    settled = F.col("need").isNotNull() & early.eqNullSafe(late)
    stay = F.col("need").isNull() | ~on
    return met.select(
        "url", "first", F.when(settled, early).otherwise(F.col("lo")).alias("lo"), F.when(settled, late).otherwise(F.col("hi")).alias("hi"),
        F.when(~settled, F.when(on, F.col("to_need")).otherwise(F.col("need"))).alias("need"),
        F.when(stay, F.col("at")).otherwise(F.col("to_at")).alias("at"),
        F.when(stay, F.col("early")).otherwise(early).alias("early"), F.when(stay, F.col("late")).otherwise(late).alias("late"),
    )


def _jumps_left(links: DataFrame) -> DataFrame:
    """Links that wait for a link or for a URL whose time is known."""
    ready = links.where(F.col("need").isNotNull() | F.col("lo").eqNullSafe(F.col("hi"))).select(F.col("url").alias("need"))
    return links.where(F.col("need").isNotNull()).join(ready, "need", "left_semi")


def _first_success(several: DataFrame, bounds: DataFrame) -> DataFrame:
    """(url, since) of all URLs of ``bounds``."""
    open_url = ~F.col("lo").eqNullSafe(F.col("hi"))
    while not bounds.where(open_url).isEmpty():
        groups = several.join(bounds.where(open_url).select("url"), "url", "left_semi").select("group_id").distinct()
        links = materialize(_links(several.join(groups, "group_id", "left_semi"), bounds), "links")
        while not _jumps_left(links).isEmpty():
            # two doublings a stored table
            links = materialize(_doubled(_doubled(links)), "links")
        bounds = links.select("url", "first", "lo", "hi")
    return bounds.select("url", F.col("hi").alias("since"))


def gate_with_aliases(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """``action`` (``try``, ``ledger_skip``, ``duplicate``) for every URL row.

    ``rows``: created_at, task_id, pos, url, video_id, success, where success
    is what a try would give.  A URL occurs once per task.
    """
    at = F.struct(*TASK_ORDER)
    never = F.struct(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in TASK_ORDER])
    keyed = rows.withColumn("at", at)
    slim = keyed.select(
        F.col("video_id").alias("group_id"), "task_id", "url", "at", "pos",
        F.coalesce("success", F.lit(False)).alias("success"),
    )

    sizes = slim.where("group_id IS NOT NULL").groupBy("group_id", "task_id").agg(F.count(F.lit(1)).alias("n"))
    marked = slim.join(sizes.where("n > 1"), ["group_id", "task_id"], "left")
    several = materialize(marked.where("n IS NOT NULL").drop("n"), "several_urls")

    # First success by certain rows; a ledger success (NULL fields) is before every task.
    certain = marked.where("n IS NULL AND success").select("url", "at")
    done = ledger.where("success").select("url", never.alias("at"))
    first = certain.unionByName(done).groupBy("url").agg(F.min("at").alias("first"))

    if several.isEmpty():
        return _with_action(keyed, first.select("url", F.col("first").alias("since")), None)

    wins = several.groupBy("url").agg(F.min(F.when(F.col("success"), F.col("at"))).alias("win"))
    bounds = materialize(
        wins.join(first, "url", "left").select("url", "first", F.least("first", "win").alias("lo"), F.col("first").alias("hi")),
        "bounds",
    )
    solved = _first_success(several, bounds)
    known = first.join(solved, "url", "left_anti").select("url", F.col("first").alias("since")).unionByName(
        solved.where("since IS NOT NULL")
    )
    tried = (
        several.join(solved, "url")
        .where(~F.coalesce(F.col("since") < F.col("at"), F.lit(False)))
        .groupBy(F.col("group_id").alias("video_id"), "task_id")
        .agg(F.min("pos").alias("first_pos"))
    )
    return _with_action(keyed, known, tried)


def _with_action(keyed: DataFrame, known: DataFrame, tried: DataFrame | None) -> DataFrame:
    gated = keyed.join(known, "url", "left")
    if tried is None:
        gated = gated.withColumn("first_pos", F.lit(None).cast("int"))
    else:
        gated = gated.join(tried, ["video_id", "task_id"], "left")
    return gated.withColumn(
        "action",
        F.when(F.coalesce(F.col("since") < F.col("at"), F.lit(False)), "ledger_skip")
        .when(F.col("pos") > F.col("first_pos"), "duplicate")
        .otherwise("try"),
    ).drop("at", "since", "first_pos")
