"""States that rules and routing imply for every recorded run.

All runs advance together, one level of the catalog at a time: the states of
earlier levels meet the level's edges, are counted per (run, task) with a
map-side aggregate, and give the level's verdicts. Teardowns follow in a
second pass. Work per level is one shuffle over (run, task), whatever the
size of one DAG or run.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.rules import blocked_state, rule_satisfied
from runlens.functions.skew import unbroadcast
from runlens.operators import graph as G
from runlens.operators import rules
from runlens.session import cut_lineage

_KEY = ["dag_id", "run_id", "task_id"]
# Recorded states that show the task was started or is about to be.
_EXECUTED = ("success", "failed", "skipped", "running", "queued", "scheduled", "up_for_retry")


def _verdicts(
    candidates: DataFrame, edges: DataFrame, resolved: DataFrame, skips: DataFrame
) -> DataFrame:
    """Resolve one level: (dag_id, run_id, task_id, state)."""
    counts = rules.upstream_counts(edges, resolved).drop("n_total")
    numbers = [name for name in counts.columns if name.startswith("n_")]
    joined = candidates.join(unbroadcast(counts), _KEY, "left").join(unbroadcast(skips), _KEY, "left").select(
        *candidates.columns, "is_skipped",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in numbers],
    )
    settled = F.col("n_terminal") >= F.col("n_total")
    state = (
        F.when(F.col("is_skipped"), "skipped")
        .when(~settled, "none")
        .when(rule_satisfied(F.col("trigger_rule")), F.col("outcome"))
        .otherwise(blocked_state(F.col("n_broken")))
    )
    return joined.select(*_KEY, state.alias("state"))


def reconcile_states(
    tasks: DataFrame, runs: DataFrame, recorded: DataFrame, directives: DataFrame,
    resume: bool = False,
) -> DataFrame:
    """(dag_id, run_id, task_id, recorded_state, implied_state, agrees).

    `tasks` is the catalog, `recorded` the current states, `directives` the
    rows of the routing operators for tasks that succeeded. With `resume`,
    directives of tasks that were already final are not applied again.
    """
    edges = cut_lineage(G.adjacency(tasks))
    teardowns = G.teardown_pairs(tasks)
    nodes = tasks.select("dag_id", F.col("task_id").alias("node"))
    placed = cut_lineage(
        G.peel(edges, nodes)[0].withColumnRenamed("node", "task_id")
        .join(unbroadcast(tasks), ["dag_id", "task_id"])
        .select(
            "dag_id", "task_id", "trigger_rule", "level",
            F.size("upstream").cast("long").alias("n_total"),
            (F.coalesce("teardown", F.lit("")) != "").alias("is_teardown"),
        )
    )
    deepest = placed.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]

    recorded = recorded.select(*_KEY, F.col("state").alias("recorded_state"))
    outcome = F.when(F.col("recorded_state").isin(*_EXECUTED), F.col("recorded_state"))
    cells = cut_lineage(
        runs.select("dag_id", "run_id").join(unbroadcast(placed), "dag_id")
        .join(unbroadcast(recorded), _KEY, "left")
        .withColumn("outcome", F.coalesce(outcome, F.lit("none")))
    )
    orders = cut_lineage(
        directives.filter("directive = 'skip'").select(
            "dag_id", "run_id", F.col("task_id").alias("router"),
            F.col("target").alias("task_id"),
        ).distinct()
    )

    def skips_from(resolved: DataFrame) -> DataFrame:
        """Skips count only where the router itself was implied to succeed."""
        succeeded = resolved.filter("state = 'success'").select(
            "dag_id", "run_id", F.col("task_id").alias("router")
        )
        return orders.join(unbroadcast(succeeded), ["dag_id", "run_id", "router"], "left_semi").select(
            *_KEY
        ).distinct().withColumn("is_skipped", F.lit(True))

    teardown_start = cells.filter("is_teardown").select(*_KEY, F.lit("none").alias("state"))
    normal = cells.filter(~F.col("is_teardown"))
    if resume:
        orders = orders.filter(F.lit(False))
    layers = [teardown_start]
    for level in range(deepest + 1):
        resolved = reduce(DataFrame.unionByName, layers)
        layers.append(
            cut_lineage(
                _verdicts(
                    normal.filter(F.col("level") == level), edges, resolved,
                    skips_from(resolved),
                )
            )
        )

    # Teardown pass: dependencies are the setup and what it leads to, and the
    # rule is all_done whatever the task says.
    done = reduce(DataFrame.unionByName, layers[1:])
    deps = G.teardown_deps(edges, teardowns).select(
        "dag_id", F.col("dep").alias("upstream"), F.col("teardown").alias("downstream")
    ).distinct()
    wanted = deps.groupBy("dag_id", F.col("downstream").alias("task_id")).agg(
        F.count(F.lit(1)).alias("n_total")
    )
    closing = cells.filter("is_teardown").drop("n_total", "trigger_rule").join(
        unbroadcast(wanted), ["dag_id", "task_id"]
    ).withColumn("trigger_rule", F.lit("all_done"))
    no_skips = skips_from(done).filter(F.lit(False))
    ended = _verdicts(closing, deps, done, no_skips)

    implied = done.unionByName(ended).withColumnRenamed("state", "implied_state")
    seen = F.coalesce("recorded_state", F.lit("none"))
    return cells.select(*_KEY, "recorded_state").join(unbroadcast(implied), _KEY).select(
        *_KEY, seen.alias("recorded_state"), "implied_state",
        (seen == F.col("implied_state")).alias("agrees"),
    )


