"""Trigger rules over the whole history.

Shapes: `tasks` (dag_id, task_id, trigger_rule, upstream ARRAY),
`edges` (dag_id, upstream, downstream), `states` (dag_id, run_id, task_id,
state), `runs` (dag_id, run_id).

Counting is one aggregate per (run, task) with a map-side part, so a DAG that
holds a third of all runs spreads over all reducers. Edges and tasks are the
catalog, which grows too: they are joined by shuffle, the history salted against
copies of the catalog, and pass through no driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.rules import blocked_state, rule_columns, rule_satisfied
from runlens.functions.skew import spread_join
from runlens.functions.states import is_terminal
from runlens.values import TRIGGER_RULES

COUNTS = ("success", "failed", "skipped", "upstream_failed", "done", "total")
_KEY = ["dag_id", "run_id", "task_id"]
# Copies of the catalog's rows, and so tasks that share the history of one DAG's task.
EDGE_COPIES = 16


def upstream_counts(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Counts of reported upstream states per (run, task with upstreams).

    `n_total` is the number of upstreams that reported; use
    `evaluate_trigger_rules` for the declared number.
    """
    # One task of one DAG may hold much of the history: its states are salted against copies of its edges.
    seen = spread_join(
        states.select("dag_id", "run_id", F.col("task_id").alias("upstream"), "state"), edges,
        ["dag_id", "upstream"], copies=EDGE_COPIES,
    )
    state = F.col("state")
    named = state.isin("success", "failed", "skipped")
    return seen.groupBy("dag_id", "run_id", F.col("downstream").alias("task_id")).agg(
        F.count_if(state == "success").alias("n_success"),
        F.count_if(state == "failed").alias("n_failed"),
        F.count_if(state == "skipped").alias("n_skipped"),
        F.count_if(~named).alias("n_upstream_failed"),
        F.count(F.lit(1)).alias("n_done"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(is_terminal(state)).alias("n_terminal"),
        F.count_if(state.isin("failed", "upstream_failed")).alias("n_broken"),
    )


def _with_counts(
    tasks: DataFrame, edges: DataFrame, states: DataFrame, runs: DataFrame
) -> DataFrame:
    """Every (run, task of its DAG) with counts; tasks without reports get zeros."""
    counts = upstream_counts(edges, states).drop("n_total")
    declared = tasks.select("dag_id", "task_id", "trigger_rule", F.size("upstream").cast("long").alias("n_total"))
    base = spread_join(runs.select("dag_id", "run_id"), declared, ["dag_id"], copies=EDGE_COPIES)
    numbers = [name for name in counts.columns if name.startswith("n_")]
    return base.join(counts, _KEY, "left").select(
        *_KEY, "trigger_rule", "n_total",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in numbers],
    )


def evaluate_trigger_rules(
    tasks: DataFrame, edges: DataFrame, states: DataFrame, runs: DataFrame
) -> DataFrame:
    """Does each task's own rule hold, given the upstreams that reported so far?"""
    return _with_counts(tasks, edges, states, runs).withColumn(
        "satisfied", rule_satisfied(F.col("trigger_rule"))
    )


def evaluate_all_rules(
    tasks: DataFrame, edges: DataFrame, states: DataFrame, runs: DataFrame,
    wide: bool = False,
) -> DataFrame:
    """All ten rules per (run, task): one row per rule, or one column per rule."""
    outcomes = rule_columns()
    columns = [outcome.alias(rule) for rule, outcome in outcomes.items()]
    table = _with_counts(tasks, edges, states, runs).select(*_KEY, *columns)
    if wide:
        return table
    return table.unpivot(_KEY, list(outcomes), "rule", "satisfied")


def run_states(states: DataFrame, teardowns: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """State of each run: `running` until all its reported tasks are final.

    Outcomes of teardown tasks do not count for or against a run. With `runs`
    every run has a row; one that no task has reported for is running.
    """
    marks = teardowns.select(
        "dag_id", F.col("teardown").alias("task_id"), F.lit(True).alias("is_teardown")
    )
    counts_against = F.col("is_teardown").isNull() & F.col("state").isin(
        "failed", "upstream_failed"
    )
    judged = (
        states.join(marks, ["dag_id", "task_id"], "left")
        .groupBy("dag_id", "run_id")
        .agg(
            F.when(~F.bool_and(is_terminal(F.col("state"))), "running")
            .when(F.bool_or(counts_against), "failed").otherwise("success")
            .alias("run_state")
        )
    )
    if runs is None:
        return judged
    return runs.select("dag_id", "run_id").join(judged, ["dag_id", "run_id"], "left").select(
        "dag_id", "run_id", F.coalesce("run_state", F.lit("running")).alias("run_state")
    )


def ready_tasks(
    tasks: DataFrame, edges: DataFrame, states: DataFrame, runs: DataFrame
) -> DataFrame:
    """What to do with every task still in state none.

    `decision` is `run` when all upstreams are final and the rule holds,
    `upstream_failed` or `skipped` when it cannot hold any more, `unknown_rule`
    where the rule's name is none, `wait` otherwise. `states` must hold one row per recorded (run, task).
    """
    counted = _with_counts(tasks, edges, states, runs)
    pending = counted.join(
        states.filter(F.col("state") != "none").select(*_KEY), _KEY, "left_anti"
    )
    settled = F.col("n_terminal") >= F.col("n_total")
    return pending.withColumn(
        "decision",
        F.when(~F.coalesce(F.col("trigger_rule").isin(*TRIGGER_RULES), F.lit(False)), "unknown_rule")
        .when(~settled, "wait")
        .when(rule_satisfied(F.col("trigger_rule")), "run")
        .otherwise(blocked_state(F.col("n_broken"))),
    ).select(*_KEY, "trigger_rule", "decision")
