"""What branches and gates do to their direct downstream tasks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.skew import spread_join
from runlens.operators.sets import branch_split


def _member_type(raw: Column, name: str) -> Column:
    member = F.variant_get(F.try_parse_json(raw), f"$.{name}", "variant")
    return F.schema_of_variant(member)


def _has(raw: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(raw), name), F.lit(False))


def _texts(raw: Column, name: str) -> Column:
    return F.coalesce(
        F.from_json(F.get_json_object(raw, f"$.{name}"), "array<string>"),
        F.array().cast("array<string>"),
    )


def _truthy(raw: Column, name: str) -> Column:
    kind, text = _member_type(raw, name), F.get_json_object(raw, f"$.{name}")
    return F.coalesce(
        F.when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def normalize_outputs(contexts: DataFrame) -> DataFrame:
    """A bare `_result` is no output of a plain task; objects stay as they are."""
    raw = F.col("raw_outputs")
    bare = _has(raw, "_result") & (F.size(F.json_object_keys(raw)) == 1)
    return contexts.withColumn("outputs", F.when(bare, "{}").otherwise(raw))


def branch_outputs(results: DataFrame) -> DataFrame:
    """The ids a branch chose, as array column `branch`.

    Needs `raw_outputs`, `success`, `failure`. Where the task itself returned
    a `branch` that is no list, `branch` is null.
    """
    raw = F.col("raw_outputs")
    kind = _member_type(raw, "_result")
    result = F.get_json_object(raw, "$._result")
    wrapped = (
        F.when(kind.startswith("ARRAY"), _texts(raw, "_result"))
        .when(kind == "STRING", F.array(result))
        .when((kind == "BOOLEAN") & (result == "false"), F.col("failure"))
        .otherwise(F.col("success"))
    )
    own = F.when(_member_type(raw, "branch").startswith("ARRAY"), _texts(raw, "branch"))
    return results.withColumn(
        "branch",
        F.when(_has(raw, "_result"), wrapped)
        .when(_has(raw, "branch"), own)
        .otherwise(F.col("success")),
    )


def _children(edges: DataFrame) -> DataFrame:
    """Direct downstream tasks per task, in order."""
    return edges.groupBy("dag_id", F.col("upstream").alias("task_id")).agg(
        F.array_sort(F.collect_set("downstream")).alias("downstream")
    )


def _exploded(df: DataFrame, schedule: Column, skip: Column) -> DataFrame:
    steps = F.concat(
        F.transform(schedule, lambda t: F.struct(F.lit("schedule").alias("directive"), t.alias("target"))),
        F.transform(skip, lambda t: F.struct(F.lit("skip").alias("directive"), t.alias("target"))),
    )
    return df.select("dag_id", "run_id", "task_id", F.inline(steps))


def branch_directives(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag_id, run_id, task_id, directive, target) for every branch that succeeded."""
    none = F.array().cast("array<string>")
    routed = spread_join(
        branch_outputs(results), _children(edges), ["dag_id", "task_id"], "left"
    )
    downstream = F.coalesce("downstream", none)
    scheduled, skipped = branch_split(
        F.col("branch"), F.col("success"), F.col("failure"), downstream
    )
    listed = F.col("branch").isNotNull()
    return _exploded(
        routed,
        F.when(listed, scheduled).otherwise(F.col("success")),
        F.when(listed, skipped).otherwise(F.col("failure")),
    )


def gate_continues(results: DataFrame) -> DataFrame:
    """Does a short-circuit task let its downstream go on? Default is yes."""
    raw = F.col("raw_outputs")
    return results.withColumn(
        "continues",
        F.when(_has(raw, "_result"), _truthy(raw, "_result"))
        .when(_has(raw, "continue"), _truthy(raw, "continue"))
        .otherwise(True),
    )


def short_circuit_directives(results: DataFrame, edges: DataFrame) -> DataFrame:
    """A closed gate skips all its direct downstream tasks, an open one schedules them."""
    routed = spread_join(gate_continues(results), _children(edges), ["dag_id", "task_id"])
    none = F.array().cast("array<string>")
    return _exploded(
        routed,
        F.when(F.col("continues"), F.col("downstream")).otherwise(none),
        F.when(F.col("continues"), none).otherwise(F.col("downstream")),
    )
