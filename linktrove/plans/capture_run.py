"""One capture run: from tasks and a ledger to outcomes, ledger changes and report."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktrove.operators import aliases
from linktrove.operators import ledger as L
from linktrove.operators import outcomes as O
from linktrove.operators import report as R
from linktrove.operators import tasks as K
from linktrove.sources.scratch import materialize, materialize_counted


def gated_rows(
    tasks: DataFrame, ledger: DataFrame | Callable[[DataFrame], DataFrame], attempts: DataFrame, recorded_only: bool = False,
) -> DataFrame:
    """URL rows of workable tasks with their action and attempt.

    ``ledger`` may be a function of the URL rows, which then reads what concerns them.
    ``attempts`` gives the outcome of every (task, url) if it is tried.  With
    ``recorded_only`` it holds only what really was tried, and the plain gate
    without rounds is enough.
    """
    workable = K.label_filter(tasks).where(~F.col("has_notebook"))
    urls = K.extract_task_urls(workable)
    recorded = attempts.drop("pos")
    rows = urls.join(recorded, ["task_id", "url"], "left")
    # Several branches read the rows; write them once instead of extracting again.
    rows = materialize(rows.withColumn("success", O.is_ok(F.col("content"), F.col("error"))), "url_rows")
    if not isinstance(ledger, DataFrame):
        ledger = ledger(rows)
    return L.gate_rows(rows, ledger) if recorded_only else aliases.gate_with_aliases(rows, ledger)


class CaptureRun:
    """Results of one run; each is planned when asked for.

    Gated rows and outcomes are stored once, whatever number of results reads them;
    the run counters are gathered while the outcomes are written.

    ``attempts``: see :func:`gated_rows`; ``run_at`` stamps the ledger changes.
    """

    def __init__(
        self, tasks: DataFrame, projects: DataFrame, ledger: DataFrame, attempts: DataFrame, run_at: str,
        max_tasks: int | None = None, no_close: bool = False, recorded_only: bool = False,
    ):
        self.run_at, self.no_close = run_at, no_close
        self.scope = K.capture_scope(tasks, projects, require=True)
        self.chosen = K.notebook_gate(K.oldest_tasks(self.scope, max_tasks))
        self.gated = gated_rows(self.chosen, ledger, attempts, recorded_only)

    @cached_property
    def rows(self) -> DataFrame:
        return materialize(self.gated, "gated_rows")

    @property
    def tried(self) -> DataFrame:
        return self.rows.where(F.col("action") == "try")

    @cached_property
    def _stored(self) -> tuple[DataFrame, dict[str, int]]:
        folded = O.task_outcome(self.chosen.select("id", "labels", "has_notebook"), self.rows, self.no_close)
        return materialize_counted(folded, "outcomes", *O.outcome_counters())

    @property
    def outcomes(self) -> DataFrame:
        return self._stored[0]

    @property
    def ledger_changes(self) -> DataFrame:
        at = F.lit(self.run_at).cast("timestamp_ntz")
        return L.latest_updates(self.tried.withColumn("processed_at", at), L.ORDER)

    @property
    def report(self) -> DataFrame:
        reported = self.outcomes.where("in_report").select("task_id")
        shown = self.chosen.join(reported, F.col("id") == F.col("task_id"), "left_semi")
        return R.task_report(shown, self.tried.join(reported, "task_id", "left_semi"))

    @property
    def summary(self) -> DataFrame:
        return O.run_summary(self.scope, self._stored[1])
