"""All plan checks for all DAGs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import SECRETS_PATTERN
from runlens.operators import graph as G
from runlens.operators import joins as J
from runlens.operators import variables as V
from runlens.operators.aggregates import duplicate_task_ids, required_variables
from runlens.values import TRIGGER_RULES


def catalog_issues(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """Errors and warnings of every DAG as (dag_id, task_id, severity, code, concerns).

    A DAG with a cycle gives one row per task on the cycle or behind it.
    """
    duplicates = J.issue_rows(duplicate_task_ids(tasks), "error", "repeated_task")
    nodes = tasks.select("dag_id", F.col("task_id").alias("node"))
    cyclic = G.find_cycles(G.adjacency(tasks), nodes).withColumnRenamed("node", "task_id")
    cycles = J.issue_rows(cyclic, "error", "cyclic")
    issues = (
        duplicates.unionByName(J.missing_plugins(tasks, registry))
        .unionByName(J.missing_upstreams(tasks))
        .unionByName(J.bad_teardowns(tasks))
        .unionByName(cycles)
    )
    if "trigger_rule" in tasks.columns:
        known = F.coalesce(F.col("trigger_rule").isin(*TRIGGER_RULES), F.lit(False))
        issues = issues.unionByName(J.issue_rows(tasks.filter(~known), "error", "unknown_rule", "trigger_rule"))
    return issues


def input_issues(inputs: DataFrame, provided: DataFrame, secrets: DataFrame) -> DataFrame:
    """Warnings about the templates of task inputs, as (dag_id, task_id, severity, code, concerns).

    `inputs` has (dag_id, task_id, template), `provided` (dag_id, var_key, var_value),
    `secrets` (key). A variable without a value that some use gives no default for, and a
    secret that is not there, are named once per DAG, without a task; a reference of no
    known kind is named for each task that holds it.
    """
    placed = inputs.select("dag_id", "task_id", "template", F.xxhash64("template").alias("__at"))
    wanted = required_variables(placed, provided, ["task_id", "__at"], ["dag_id"])
    lost = wanted.filter(F.col("found_in").isNull() & ~F.col("has_default"))
    no_task = F.lit(None).cast("string")
    named = inputs.select("dag_id", F.explode(F.regexp_extract_all("template", F.lit(SECRETS_PATTERN), 1)).alias("key")).distinct()
    unset = named.join(secrets.select("key").distinct(), "key", "left_anti")
    held = inputs.select("dag_id", "task_id", F.explode(V.references(F.col("template"))).alias("reference")).distinct()
    strange = held.filter(~V.is_known_reference(F.col("reference")))
    return (
        J.issue_rows(lost.withColumn("task_id", no_task), "warning", "missing_variable", "var_key")
        .unionByName(J.issue_rows(unset.withColumn("task_id", no_task), "warning", "missing_secret", "key"))
        .unionByName(J.issue_rows(strange, "warning", "unknown_reference", "reference"))
    )


def plan_catalog(
    tasks: DataFrame, registry: DataFrame, inputs: DataFrame | None = None,
    provided: DataFrame | None = None, secrets: DataFrame | None = None,
) -> DataFrame:
    """One row per DAG: is it valid, and how many errors and warnings it has.

    With `inputs`, `provided` and `secrets` the warnings of `input_issues` count as well.
    """
    found = catalog_issues(tasks, registry)
    if inputs is not None:
        found = found.unionByName(input_issues(inputs, provided, secrets))
    issues = found.groupBy("dag_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    dags = tasks.groupBy("dag_id").agg(F.count(F.lit(1)).alias("tasks"))
    return dags.join(issues, "dag_id", "left").select(
        "dag_id", "tasks",
        (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
    )
