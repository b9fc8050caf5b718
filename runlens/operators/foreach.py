"""One task for each item of a list, and the list of their outputs for the tasks behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TASK = ["dag_id", "run_id", "task_id"]


def _items():
    """The list in the column `items`, JSON text; null where that is no list."""
    listed = F.when(F.ltrim("items").startswith("["), F.from_json("items", "array<string>"))
    return F.when(F.get_json_object("items", "$").isNotNull(), listed)


def expand_foreach(tasks: DataFrame) -> DataFrame:
    """An instance per item: (dag_id, run_id, task_id, item_index, instance_id, item).

    `tasks` has (dag_id, run_id, task_id, items) with `items` the JSON list that
    the run was triggered with. Items stay in order and are text: strings without their
    quotes, other values as JSON, null as null. An empty list has no instances; what
    is null or no list has none either and is named by `foreach_problems`.
    """
    listed = tasks.select(*_TASK, F.posexplode(_items()).alias("item_index", "item"))
    instance = F.concat("task_id", F.lit("["), F.col("item_index").cast("string"), F.lit("]"))
    return listed.select(*_TASK, "item_index", instance.alias("instance_id"), "item")


def foreach_problems(tasks: DataFrame) -> DataFrame:
    """Tasks without a list: (dag_id, run_id, task_id, problem), `no_items` or `not_a_list`."""
    return tasks.filter(_items().isNull()).select(
        *_TASK, F.when(F.col("items").isNull(), "no_items").otherwise("not_a_list").alias("problem")
    )


def gather_outputs(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """The outputs of all instances in the order of the items: (dag_id, run_id, task_id, outputs, missing).

    `outputs` has (dag_id, run_id, task_id, item_index, output). An instance without
    an output counts as null in its place; an empty list gives an empty list; a task
    without a list has no row; outputs of an index that the list does not have are
    left out. Should an instance have several outputs, the greatest counts.

    A task's outputs are one list in one row, as its items were; the outputs are
    reduced to one per instance before they come together.
    """
    sized = tasks.select(*_TASK, F.size(_items()).alias("n")).filter(F.col("n") >= 0)
    one = outputs.groupBy(*_TASK, "item_index").agg(F.max("output").alias("output"))
    held = one.groupBy(*_TASK).agg(F.map_from_entries(F.collect_list(F.struct("item_index", "output"))).alias("held"))
    whole = F.when(
        F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("held", i))
    ).otherwise(F.array().cast("array<string>"))
    filled = sized.join(held, _TASK, "left").withColumn("outputs", whole)
    return filled.select(*_TASK, "outputs", F.size(F.filter("outputs", lambda x: x.isNull())).alias("missing"))


def downstream_lists(gathered: DataFrame, edges: DataFrame) -> DataFrame:
    """What each task behind a foreach task receives: (dag_id, run_id, task_id, upstream, outputs)."""
    links = edges.select("dag_id", F.col("upstream").alias("task_id"), "downstream").distinct()
    return gathered.join(links, ["dag_id", "task_id"]).select(
        "dag_id", "run_id", F.col("downstream").alias("task_id"), F.col("task_id").alias("upstream"), "outputs"
    )


def foreach_states(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """State of each foreach task from its instances': (dag_id, run_id, task_id, state).

    `states` has (dag_id, run_id, task_id, item_index, state). Without items the task is skipped;
    while an instance has not ended, or has not reported, it is running; then failed
    if one failed, skipped if all were, else a success.
    """
    sized = tasks.select(*_TASK, F.size(_items()).alias("n")).filter(F.col("n") >= 0)
    state = F.col("state")
    seen = states.groupBy(*_TASK).agg(
        F.count_if(state.isin("success", "failed", "skipped", "upstream_failed")).alias("ended"),
        F.count_if(state.isin("failed", "upstream_failed")).alias("broken"), F.count_if(state == "skipped").alias("skipped"),
    )
    return sized.join(seen, _TASK, "left").select(
        *_TASK,
        F.when(F.col("n") == 0, "skipped").when(F.coalesce("ended", F.lit(0)) < F.col("n"), "running")
        .when(F.col("broken") > 0, "failed").when(F.col("skipped") == F.col("n"), "skipped").otherwise("success").alias("state"),
    )
