"""Grouped summaries. All of them have a map-side part."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.maps import json_at
from runlens.functions.text import SECRETS_PATTERN, VARS_PATTERN, strip


def state_map(states: DataFrame) -> DataFrame:
    """Per run the map task -> state. Its size is the DAG's number of tasks."""
    entries = F.array_sort(F.collect_list(F.struct("task_id", "state")))
    return states.groupBy("dag_id", "run_id").agg(
        F.map_from_entries(entries).alias("task_states")
    )


def context_map(contexts: DataFrame) -> DataFrame:
    """Per run the contexts of its tasks, in task order."""
    held = [name for name in contexts.columns if name not in ("dag_id", "run_id", "task_id")]
    return contexts.groupBy("dag_id", "run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("task_id", F.struct(*held).alias("context")))
        ).alias("contexts")
    )


def active_counts(runs: DataFrame) -> DataFrame:
    """Running runs per deployment; runs without a deployment form their own row."""
    return runs.filter(F.col("state") == "running").groupBy("deployment_id").agg(
        F.count(F.lit(1)).alias("active_runs")
    )


def fleet_counts(runs: DataFrame, tasks: DataFrame, deployments: DataFrame) -> DataFrame:
    """What the listings show, per DAG and in total, as (measure, dag_id, state, n)."""

    def counted(df: DataFrame, measure: str, state) -> DataFrame:
        shaped = df.select("dag_id", state.alias("state"))
        return shaped.groupingSets(
            [["dag_id", "state"], ["state"], []], "dag_id", "state"
        ).agg(
            F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")
        ).select(F.lit(measure).alias("measure"), "dag_id", "state", "level", "n")

    none = F.lit(None).cast("string")
    return (
        counted(runs, "runs", F.col("state"))
        .unionByName(counted(tasks, "actions", F.coalesce(F.col("type"), none)))
        .unionByName(
            counted(
                deployments, "deployments",
                F.when(F.coalesce("enabled", F.lit(True)), "enabled").otherwise("disabled"),
            )
        )
    )


def bundle_counts(dags: DataFrame) -> DataFrame:
    """DAGs and failed DAGs per bundle, from (bundle, dag_id, is_valid)."""
    return dags.groupBy("bundle").agg(
        F.count(F.lit(1)).alias("dags"),
        F.count_if(~F.col("is_valid")).alias("failed"),
    )


def multi_dag_folders(documents: DataFrame) -> DataFrame:
    """Folders with more than one file that yields a DAG, from (folder, file)."""
    # Two aggregates instead of a distinct count, so one huge folder is
    # deduplicated on all reducers before it is counted.
    files = documents.select("folder", "file").distinct()
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def duplicate_task_ids(tasks: DataFrame) -> DataFrame:
    return (
        tasks.groupBy("dag_id", "task_id").agg(F.count(F.lit(1)).alias("uses"))
        .filter("uses > 1")
    )


def template_references(inputs: DataFrame, template: str = "template") -> DataFrame:
    """Every `vars()` call of every input, as (.., position, var_key, default_text).

    `default_text` is null where the call gives no default.
    """
    keys = F.regexp_extract_all(template, F.lit(VARS_PATTERN), 1)
    defaults = F.regexp_extract_all(template, F.lit(VARS_PATTERN), 2)
    kept = [name for name in inputs.columns if name != template]
    calls = F.arrays_zip(keys.alias("var_key"), defaults.alias("default_text"))
    return inputs.select(*kept, F.posexplode(calls).alias("position", "call")).select(
        *kept, "position", "call.var_key",
        F.when(F.col("call.default_text") != "", strip(F.col("call.default_text")))
        .alias("default_text"),
    )


def required_variables(
    inputs: DataFrame, provided: DataFrame, order: list[str],
    scope: list[str] | None = None,
) -> DataFrame:
    """Per variable: has every use a default, the first default, is it provided.

    `provided` has (var_key, var_value as JSON or text); dotted keys look into
    the JSON of their first part. `scope` names columns shared by both sides
    (a DAG, say) within which the answer is wanted.
    """
    scope = scope or []
    calls = template_references(inputs)
    first = F.min_by("default_text", F.struct(*order, "position"))
    wanted = calls.groupBy(*scope, "var_key").agg(
        F.bool_and(F.col("default_text").isNotNull()).alias("has_default"),
        first.alias("default_value"),
    )
    head = F.substring_index("var_key", ".", 1)
    rest = F.expr("substring(var_key, length(substring_index(var_key, '.', 1)) + 2)")
    known = provided.select(*scope, F.col("var_key").alias("head"), "var_value")
    found = F.when(F.col("rest") == "", F.col("known")).otherwise(
        F.col("known")
        & json_at(F.col("var_value"), F.concat(F.lit("$."), F.col("rest"))).isNotNull()
    )
    return (
        wanted.withColumns({"head": head, "rest": rest})
        .join(known.withColumn("known", F.lit(True)), [*scope, "head"], "left")
        .select(
            *scope, "var_key", "has_default",
            F.when(F.col("has_default"), F.col("default_value")).alias("default_value"),
            F.when(F.coalesce(found, F.lit(False)), "variables").alias("found_in"),
        )
    )


def required_secrets(inputs: DataFrame, provided: DataFrame) -> DataFrame:
    """Distinct secret names and where they were found; `provided` has (key)."""
    names = F.regexp_extract_all("template", F.lit(SECRETS_PATTERN), 1)
    wanted = inputs.select(F.explode(names).alias("key")).distinct()
    known = provided.select("key").distinct().withColumn("found_in", F.lit("environment"))
    return wanted.join(known, "key", "left")

