"""Zombies, orphaned runs and table upkeep.

Upkeep gives new rows or a new frame; nothing is changed in place. Write the
result with `sources.sinks.write_snapshot` or append it to the event log.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.states import is_terminal, seconds_between
from runlens.operators.filters import active_runs
from runlens.values import ZOMBIE_THRESHOLD_SECONDS

_RUN = ["dag_id", "run_id"]
_KEY = [*_RUN, "task_id"]


def zombie_tasks(
    runs: DataFrame, states: DataFrame, now: Column,
    threshold: int = ZOMBIE_THRESHOLD_SECONDS,
) -> DataFrame:
    """Running tasks of active runs whose heartbeat is missing or too old."""
    silence = seconds_between(F.col("heartbeat_at"), now)
    suspects = states.filter("state = 'running'").withColumn(
        "seconds_since_heartbeat", F.coalesce(silence, F.lit(float(threshold + 1)))
    ).filter(F.col("seconds_since_heartbeat") > threshold)
    return suspects.join(active_runs(runs).select(*_RUN), _RUN, "left_semi").select(
        *_KEY, "state", "heartbeat_at", "seconds_since_heartbeat"
    )


def kill_zombies(events: DataFrame, zombies: DataFrame, now: Column) -> DataFrame:
    """The event log with a failed event appended for every zombie."""
    failed = zombies.select(*_KEY, F.lit("failed").alias("state"), now.alias("updated_at"))
    return events.unionByName(failed, allowMissingColumns=True)


def _progress(states: DataFrame) -> DataFrame:
    open_task = ~is_terminal(F.col("state"))
    return states.groupBy(*_RUN).agg(
        F.bool_and(is_terminal(F.col("state"))).alias("all_terminal"),
        F.bool_and(F.col("state") == "success").alias("all_success"),
        F.array_sort(F.collect_list(F.when(open_task, F.col("task_id")))).alias("open_tasks"),
    )


def finalize_orphans(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Active runs with nothing left to do, and the state they end in.

    Only a run whose tasks are all success is a success; a run without any
    task is one too.
    """
    progress = _progress(states).drop("open_tasks")
    return (
        active_runs(runs).select(*_RUN).join(progress, _RUN, "left")
        .filter(F.coalesce("all_terminal", F.lit(True)))
        .select(
            *_RUN,
            F.when(F.coalesce("all_success", F.lit(True)), "success")
            .otherwise("failed").alias("final_state"),
        )
    )


def recoverable_runs(runs: DataFrame, states: DataFrame, dags: DataFrame) -> DataFrame:
    """Active runs with open tasks; `is_known` tells whether their DAG is loaded."""
    known = dags.select("dag_id").distinct().withColumn("is_known", F.lit(True))
    return (
        active_runs(runs).join(_progress(states).filter(~F.col("all_terminal")), _RUN)
        .join(known, "dag_id", "left")
        .select(
            *runs.columns, F.col("open_tasks").alias("non_terminal_tasks"),
            F.coalesce("is_known", F.lit(False)).alias("is_known"),
        )
    )


def clear_contexts(contexts: DataFrame, cleared: DataFrame) -> DataFrame:
    """Contexts with attempts and outputs of the cleared tasks wiped."""
    marks = cleared.select(*_KEY).distinct().withColumn("__cleared", F.lit(True))
    hit = F.col("__cleared").isNotNull()
    wiped = {"outputs": F.when(hit, "{}").otherwise(F.col("outputs"))}
    if "attempts" in contexts.columns:
        none = F.array().cast(contexts.schema["attempts"].dataType)
        wiped["attempts"] = F.when(hit, none).otherwise(F.col("attempts"))
    return contexts.join(marks, _KEY, "left").withColumns(wiped).drop("__cleared")


def clear_states(states: DataFrame, cleared: DataFrame) -> DataFrame:
    """State table with the cleared tasks back in none; heartbeats are kept."""
    marks = cleared.select(*_KEY).distinct().withColumn("__cleared", F.lit(True))
    return states.join(marks, _KEY, "full_outer").withColumn(
        "state", F.when(F.col("__cleared").isNotNull(), "none").otherwise(F.col("state"))
    ).drop("__cleared")


def upsert_deployments(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace by id; `last_scheduled_at`, the scheduler's own mark, survives."""
    new = F.col("n.id").isNotNull()
    columns = []
    for name in current.columns:
        if name == "last_scheduled_at":
            columns.append(F.coalesce(f"c.{name}", f"n.{name}").alias(name))
        else:
            columns.append(
                F.when(new, F.col(f"n.{name}")).otherwise(F.col(f"c.{name}")).alias(name)
            )
    return current.alias("c").join(
        incoming.alias("n"), F.col("c.id") == F.col("n.id"), "full_outer"
    ).select(*columns)


def delete_by_key(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, one-row count of what went)."""
    on = keys.columns
    gone = df.join(keys, on, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return df.join(keys, on, "left_anti"), gone


def set_enabled(deployments: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply (id, flag) requests."""
    return deployments.join(requests.select("id", "flag"), "id", "left").withColumn(
        "enabled", F.coalesce("flag", "enabled")
    ).drop("flag")


def close_runs(runs: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Apply new run states (dag_id, run_id, run_state).

    Ending in success or failed sets `ended_at`; any other state clears it.
    """
    ends = F.col("run_state").isin("success", "failed")
    return runs.join(states.select(*_RUN, "run_state"), _RUN, "left").withColumns({
        "ended_at": F.when(F.col("run_state").isNull(), F.col("ended_at")).when(ends, now),
        "state": F.coalesce("run_state", "state"),
    }).drop("run_state")
