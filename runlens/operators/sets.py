"""Set operations over tasks and requests."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that are no teardown."""
    return tasks.filter(F.coalesce("teardown", F.lit("")) == "")


def affected_teardowns(teardown_deps: DataFrame, touched: DataFrame) -> DataFrame:
    """Teardowns to fire again: some dependency was touched, they themselves not.

    `teardown_deps` has (dag_id, teardown, dep), `touched` has (dag_id, run_id,
    task_id); the result has (dag_id, run_id, task_id).
    """
    met = teardown_deps.join(
        touched.select("dag_id", "run_id", F.col("task_id").alias("dep")), ["dag_id", "dep"]
    ).select("dag_id", "run_id", F.col("teardown").alias("task_id")).distinct()
    return met.join(touched, ["dag_id", "run_id", "task_id"], "left_anti")


def branch_split(
    chosen: Column, success: Column, failure: Column, downstream: Column
) -> tuple[Column, Column]:
    """(scheduled, skipped) of a branch: what it chose among what it knows, and the rest."""
    known = F.array_union(F.array_union(success, failure), downstream)
    scheduled = F.filter(chosen, lambda task: F.array_contains(known, task))
    return scheduled, F.array_except(downstream, scheduled)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Manual, scheduled and recovered firings in one shape."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
