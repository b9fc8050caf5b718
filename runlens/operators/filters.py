"""Filters and projections. None of these shuffles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import states as S
from runlens.functions import text as X
from runlens.functions.maps import json_object
from runlens.values import MARK_STATES, STANDARD_LOG_ATTRIBUTES, TERMINAL_STATES

__all__ = [
    "lookup", "active_runs", "with_terminal", "with_run_trigger", "with_run_id",
    "task_outputs", "retry_policy", "attempt_duration", "row_fingerprint",
    "route_by_hour", "classify_plugin_ref", "classify_outcome", "final_state",
    "validate_deployments", "split_lines", "tag_logs", "runtime_columns",
    "non_terminal", "markable",
]


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Keyed read; equality on partition or Parquet columns is pushed to the scan."""
    condition = F.lit(True)
    for name, value in keys.items():
        condition = condition & (F.col(name) == F.lit(value))
    return df.filter(condition)


def active_runs(runs: DataFrame, dag_id: str | None = None) -> DataFrame:
    running = runs.filter(F.col("state") == "running")
    return running if dag_id is None else running.filter(F.col("dag_id") == dag_id)


def with_terminal(df: DataFrame) -> DataFrame:
    return df.withColumn("is_terminal", S.is_terminal(F.col("state")))


def non_terminal(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("state").isin(*TERMINAL_STATES), F.lit(False)))


def with_run_trigger(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run_trigger", S.run_trigger(F.col("run_id")))


def with_run_id(df: DataFrame, trigger: Column, seed: Column | None = None) -> DataFrame:
    """Add the run id of a firing; manual firings need a `seed` that names them."""
    dag, when = F.col("dag_id"), F.col("logical_date")
    fixed = S.make_run_id(trigger, dag, when)
    if seed is None:
        return df.withColumn("run_id", fixed)
    return df.withColumn(
        "run_id",
        F.when(trigger == "manual", S.make_manual_run_id(dag, seed)).otherwise(fixed),
    )


def task_outputs(contexts: DataFrame) -> DataFrame:
    """Only keys and outputs, so the scan reads no other context column."""
    return contexts.select(
        "dag_id", "run_id", "task_id", json_object(F.col("outputs")).alias("outputs")
    )


def retry_policy(contexts: DataFrame) -> DataFrame:
    made = F.size("attempts")
    return contexts.withColumns({
        "attempt_number": made,
        "has_retries_left": S.has_retries_left(made, F.col("retries")),
        "next_retry_delay": S.next_retry_delay(
            made, F.col("retry_delay"), F.col("exponential_backoff")
        ),
    })


def attempt_duration(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn(
        "duration_sec", S.seconds_between(F.col("started_at"), F.col("ended_at"))
    )


def row_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*columns)), 256))


def route_by_hour(df: DataFrame, hours: list[int]) -> DataFrame:
    return df.withColumn("takes_success", F.hour("logical_date").isin(hours))


def classify_plugin_ref(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("__ref", X.plugin_ref(F.col("uses"))).select(
        *tasks.columns,
        F.col("__ref.kind").alias("ref_kind"),
        F.col("__ref.name").alias("ref_name"),
        F.col("__ref.version").alias("ref_version"),
        F.col("__ref.install_spec").alias("install_spec"),
    )


def classify_outcome(df: DataFrame) -> DataFrame:
    """Attempt status and retry permission from `exit_code` or `exception`.

    `exception` is the class name of what the task raised, null for none; it
    is looked at only where no exit code is recorded.
    """
    code, raised = F.col("exit_code"), F.col("exception")
    by_code = code.isNotNull()
    status = (
        F.when(by_code & (code == 0), "success")
        .when(by_code & (code == 3), "skipped")
        .when(by_code, "failed")
        .when(raised.isNull(), "success")
        .when(raised == "TaskSkipped", "skipped")
        .when(raised == "TimeoutError", "timed_out")
        .otherwise("failed")
    )
    final = (by_code & code.isin(2, 3)) | (
        ~by_code
        & F.coalesce(
            raised.isin("TaskSkipped", "TaskFailed", "NotImplementedError"), F.lit(False)
        )
    )
    return df.withColumns({
        "attempt_state": status,
        "retry_allowed": (status != "success") & ~final,
    })


def final_state(contexts: DataFrame) -> DataFrame:
    """State each task goes to after its last attempt, and the delay of a retry."""
    made = F.size("attempts")
    last = F.try_element_at("attempts", F.lit(-1))["state"]
    settled = S.settled_state(last, made, F.col("retries"))
    delay = S.next_retry_delay(made, F.col("retry_delay"), F.col("exponential_backoff"))
    return contexts.withColumns({
        "final_state": settled,
        "retry_delay_sec": F.when(settled == "up_for_retry", delay),
    })


def validate_deployments(deployments: DataFrame, cron_status: Column) -> DataFrame:
    """One row per problem, as a code: missing ids, an end that is not after the start, a cron that is
    invalid, or one that is sound but not supported here."""
    problems = F.array(
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing_id"),
        F.when(F.coalesce(F.col("dag_id"), F.lit("")) == "", "missing_dag_id"),
        F.when(
            F.col("end_date") <= F.col("start_date"), "end_not_after_start"
        ),
        F.when(F.col("cron").isNotNull() & cron_status.isin("invalid", "unsupported"), F.concat(cron_status, F.lit("_cron"))),
    )
    return deployments.select(
        "id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("issue")
    )


def split_lines(df: DataFrame, text: str, channel: str = "channel") -> DataFrame:
    """One record per non-empty line; stdout gives INFO, stderr gives ERROR."""
    kept = [name for name in df.columns if name != text]
    return (
        df.select(*kept, F.posexplode(F.split(text, "\n")).alias("line_no", "msg"))
        .filter(F.col("msg") != "")
        .withColumn(
            "level", F.when(F.col(channel) == "stdout", "INFO").otherwise("ERROR")
        )
    )


def tag_logs(records: DataFrame) -> DataFrame:
    """Raw records with struct `tags` and map `attributes` to the log schema.

    A record belongs to a task iff it carries tags. Standard and underscore
    attributes stay out of `extra`.
    """
    names = [f"tags.{name}" for name in ("dag_id", "run_id", "task_id", "attempt")]
    extra = F.map_filter(
        "attributes",
        lambda key, _: ~key.isin(*STANDARD_LOG_ATTRIBUTES) & ~key.startswith("_"),
    )
    kept = [name for name in records.columns if name not in ("tags", "attributes")]
    return records.select(
        *kept,
        F.when(F.col("tags").isNotNull(), "task").otherwise("framework").alias("source"),
        *[F.col(name) for name in names],
        extra.alias("extra"),
    )


def runtime_columns(contexts: DataFrame) -> DataFrame:
    """The eight runtime fields templates may refer to."""
    return contexts.select(
        "run_id", "dag_id", "task_id", "run_date", "logical_date",
        "data_interval_start", "data_interval_end",
        F.size("attempts").alias("attempt_number"),
    )


def markable(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("state").isin(*MARK_STATES))
