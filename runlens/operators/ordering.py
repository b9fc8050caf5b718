"""Sorted listings and top-k."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_runs(
    runs: DataFrame, dag_id: str | None = None, limit: int = 50,
    order: tuple[str, str] = ("created_at", "run_id"),
) -> DataFrame:
    """Newest runs first. Plans as one TakeOrderedAndProject."""
    chosen = runs if dag_id is None else runs.filter(F.col("dag_id") == dag_id)
    return chosen.orderBy(F.desc(order[0]), F.desc(order[1])).limit(limit)


def recent_runs_per_dag(
    runs: DataFrame, k: int, order: tuple[str, str] = ("created_at", "run_id")
) -> DataFrame:
    """The k newest runs of every DAG.

    `rank <= k` lets Spark cut each map task's part of a DAG to k rows before
    the shuffle, so a hot DAG costs k rows per task.
    """
    newest = Window.partitionBy("dag_id").orderBy(F.desc(order[0]), F.desc(order[1]))
    return runs.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)


def list_deployments(deployments: DataFrame) -> DataFrame:
    return deployments.orderBy("id")


def drain_order(
    triggers: DataFrame, deployment_id: str | None = None,
    order: tuple[str, str] = ("created_at", "trigger_id"),
) -> DataFrame:
    """Pending triggers in queue order: a range-partitioned sort, no single task."""
    chosen = triggers
    if deployment_id is not None:
        chosen = triggers.filter(F.col("deployment_id") == deployment_id)
    return chosen.orderBy(*order)
