"""Joins between runs, tasks, deployments, triggers and logs.

No join is cross. Catalog sides are broadcast only when Spark measures them
to be small; otherwise adaptive skew splitting deals with hot DAGs.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import blocks
from runlens.functions.maps import json_object, json_to_map
from runlens.functions.skew import spread_join
from runlens.functions.states import is_terminal, make_run_id
from runlens.functions.text import REMOTE_REF_PATTERN
from runlens.operators import schedule
from runlens.session import cut_lineage

_KEY = ["dag_id", "run_id", "task_id"]


def resolve_upstream_outputs(
    edges: DataFrame, contexts: DataFrame, teardowns: DataFrame | None = None
) -> DataFrame:
    """Per (run, task) the outputs of its upstreams; a teardown also sees its setup."""
    links = edges.select("dag_id", "upstream", "downstream")
    if teardowns is not None:
        links = links.unionByName(
            teardowns.select(
                "dag_id", F.col("setup").alias("upstream"), F.col("teardown").alias("downstream")
            )
        ).distinct()
    outputs = contexts.select(
        "dag_id", "run_id", F.col("task_id").alias("upstream"),
        json_object(F.col("outputs")).alias("outputs"),
    ).filter("outputs <> '{}'")
    gathered = (
        outputs.join(links, ["dag_id", "upstream"])
        .groupBy("dag_id", "run_id", F.col("downstream").alias("task_id"))
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("upstream", "outputs")))
            ).alias("upstream_outputs")
        )
    )
    empty = F.create_map().cast("map<string,string>")
    return contexts.select(*_KEY).join(gathered, _KEY, "left").select(
        *_KEY, F.coalesce("upstream_outputs", empty).alias("upstream_outputs")
    )


def issue_rows(df: DataFrame, severity: str, code: str, concerns=None) -> DataFrame:
    """Issues as (dag_id, task_id, severity, code, concerns): what is wrong with a task, and with regard to what."""
    concerns = F.lit(None).cast("string") if concerns is None else F.col(concerns)
    return df.select(
        "dag_id", "task_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), concerns.alias("concerns")
    )


def missing_upstreams(tasks: DataFrame) -> DataFrame:
    """Declared upstreams that are no task of the same DAG."""
    declared = tasks.select("dag_id", "task_id", F.explode("upstream").alias("upstream"))
    known = tasks.select("dag_id", F.col("task_id").alias("upstream"))
    missing = declared.join(known, ["dag_id", "upstream"], "left_anti")
    return issue_rows(missing, "error", "missing_upstream", "upstream")


def missing_plugins(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """Plugins not in the registry (errors); remote references give warnings."""
    remote = F.col("uses").rlike(REMOTE_REF_PATTERN)
    name = F.expr("regexp_replace(uses, '@[^@]*$', '')")
    local = tasks.filter(~remote).withColumn("plugin_name", name)
    known = registry.select("plugin_name")
    unknown = local.join(known, "plugin_name", "left_anti").join(
        known.withColumnRenamed("plugin_name", "uses"), "uses", "left_anti"
    )
    return issue_rows(unknown, "error", "unknown_plugin", "uses").unionByName(
        issue_rows(tasks.filter(remote), "warning", "remote_plugin", "uses")
    )


def bad_teardowns(tasks: DataFrame) -> DataFrame:
    """Teardowns of a task that does not exist, and teardowns of themselves."""
    marked = tasks.filter(F.coalesce("teardown", F.lit("")) != "")
    known = tasks.select("dag_id", F.col("task_id").alias("teardown"))
    lost = marked.join(known, ["dag_id", "teardown"], "left_anti")
    return issue_rows(lost, "error", "missing_setup", "teardown").unionByName(
        issue_rows(marked.filter("teardown = task_id"), "error", "own_teardown", "teardown")
    )


def roll_deployments(deployments: DataFrame, catalog: DataFrame) -> DataFrame:
    """What a sync does to each deployment; `catalog` has (dag_id, version) of valid DAGs.

    The first stamp of a version applies to pinned deployments too.
    """
    joined = deployments.join(
        catalog.select("dag_id", F.col("version").alias("bundle_version")), "dag_id", "left"
    )
    held, offered = F.col("dag_version"), F.col("bundle_version")
    verdict = (
        F.when(offered.isNull(), "unknown")
        .when(F.col("pinned") & held.isNotNull() & (held != offered), "pinned_stale")
        .when(F.col("pinned") & held.isNotNull(), "pinned_current")
        .when(held.eqNullSafe(offered), "unchanged")
        .otherwise("rolled")
    )
    return joined.withColumn("verdict", verdict).withColumn(
        "new_version", F.when(F.col("verdict") == "rolled", offered).otherwise(held)
    )


def deployment_flags(deployments: DataFrame, catalog: DataFrame) -> DataFrame:
    """Disabled, pinned and stale flags as the listing shows them."""
    joined = deployments.join(
        catalog.select("dag_id", F.col("version").alias("bundle_version")), "dag_id", "left"
    )
    stale = F.col("dag_version") != F.col("bundle_version")
    flags = F.array(
        F.when(~F.coalesce("enabled", F.lit(True)), "disabled"),
        F.when(F.col("pinned"), "pinned"),
        F.when(stale, F.concat(F.lit("stale (bundle: "), F.col("bundle_version"), F.lit(")"))),
    )
    return joined.withColumn("flags", F.filter(flags, lambda flag: flag.isNotNull()))


def accept_versions(
    deployments: DataFrame, catalog: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """Old and new version of every deployment that accepts the bundle's version.

    Without `ids` these are the pinned and stale ones; with `ids` the named
    ones, unknown ids being reported as `not_found`.
    """
    offered = catalog.select("dag_id", F.col("version").alias("new_version"))
    joined = deployments.join(offered, "dag_id").select(
        "id", F.col("dag_version").alias("previous_version"), "new_version", "pinned"
    )
    if ids is None:
        stale = ~F.col("previous_version").eqNullSafe(F.col("new_version"))
        return joined.filter(F.col("pinned") & stale).select(
            "id", "previous_version", "new_version", F.lit("accepted").alias("outcome")
        )
    named = ids.select("id").distinct()
    unknown = named.join(deployments.select("id"), "id", "left_anti")
    return joined.join(named, "id", "left_semi").select(
        "id", "previous_version", "new_version", F.lit("accepted").alias("outcome")
    ).unionByName(
        unknown.withColumn("outcome", F.lit("not_found")), allowMissingColumns=True
    )


def validate_triggers(triggers: DataFrame, requirements: DataFrame) -> DataFrame:
    """Required variables that neither the trigger nor an override provides.

    `requirements` has (deployment_id, var_key, has_default, overridden);
    the trigger's `variables` are JSON.
    """
    needed = requirements.filter(~F.col("has_default") & ~F.col("overridden"))
    given = F.map_contains_key(json_to_map(F.col("variables")), F.col("var_key"))
    return triggers.join(needed, "deployment_id").filter(~given).select(
        "trigger_id", "deployment_id", "var_key", F.lit("missing_variable").alias("error")
    )


def admit_triggers(
    triggers: DataFrame, deployments: DataFrame, dags: DataFrame,
    active: DataFrame, requirements: DataFrame,
    order: tuple[str, ...] = ("created_at", "trigger_id"),
) -> DataFrame:
    """Admission of every trigger, or the first reason against it.

    The triggers of a deployment are taken in drain order (`order`, a total one).
    Each that is fit takes one place under the limit, beside the runs that are
    active already; behind a full limit every trigger waits, fit or not.
    """
    invalid = validate_triggers(triggers, requirements).groupBy("trigger_id").agg(
        F.count(F.lit(1)).alias("missing")
    )
    # All that is known per deployment comes together first; the triggers, of
    # which one deployment may have very many, then meet it in one join.
    known = (
        deployments.select(
            F.col("id").alias("deployment_id"), "dag_id", "max_active_runs",
            F.lit(True).alias("is_deployed"),
        )
        .join(active, "deployment_id", "left")
        .join(
            dags.select("dag_id").distinct().withColumn("is_loaded", F.lit(True)),
            "dag_id", "left",
        )
    )
    facts = spread_join(triggers, known, ["deployment_id"], "left").join(
        invalid, "trigger_id", "left"
    )
    fit = F.col("missing").isNull() & F.col("is_loaded").isNotNull()
    # The running sum reads its input twice; the joins under it are done once.
    keyed = cut_lineage(facts.withColumn("__fit", fit.cast("long")).withColumn(
        "__deployment", F.coalesce("deployment_id", F.lit(""))
    ))
    queued = blocks.running_sum_before(keyed, ["__deployment"], list(order), "__fit", "__taken")
    full = F.coalesce("active_runs", F.lit(0)) + F.col("__taken") >= F.col("max_active_runs")
    return queued.withColumn(
        "verdict",
        F.when(F.col("is_deployed").isNull(), "unknown_deployment")
        .when(full, "max_active_runs")
        .when(F.col("missing").isNotNull(), "invalid_variables")
        .when(F.col("is_loaded").isNull(), "unknown_dag")
        .otherwise("admitted"),
    ).select(*triggers.columns, "dag_id", "verdict")


def runs_for_date(
    requests: DataFrame, runs: DataFrame,
    order: tuple[str, str] = ("created_at", "run_id"),
) -> DataFrame:
    """Newest run whose logical date matches the requested one.

    `requests` has (request_id, dag_id, wanted). A wanted midnight matches the
    whole day, as does a run at midnight to the minute asked for the first
    minute of its day; any other date must match exactly.
    """
    ld, wanted = F.col("logical_date"), F.col("wanted")

    def in_first_minute(at):
        return (F.hour(at) == 0) & (F.minute(at) == 0)

    best = F.max(F.struct(*order, F.col("run_id").alias("__run"))).alias
    rank = F.struct(*order, F.col("run_id").alias("__run"))
    # Runs are summed up before they meet a request: no request meets more than two rows.
    days = runs.groupBy("dag_id", F.to_date(ld).alias("__day")).agg(
        best("__any"), F.max(F.when(in_first_minute(ld), rank)).alias("__early")
    )
    exact = runs.groupBy("dag_id", ld.alias("__at")).agg(best("__exact"))
    found = requests.select("request_id", "dag_id", "wanted").withColumns(
        {"__day": F.to_date("wanted"), "__at": wanted}
    ).join(days, ["dag_id", "__day"], "left").join(exact, ["dag_id", "__at"], "left")
    midnight = in_first_minute(wanted) & (F.second(wanted) == 0)
    early = F.when(in_first_minute(wanted), F.col("__early"))
    chosen = F.when(midnight, F.col("__any")).otherwise(F.greatest("__exact", early))
    return requests.join(
        found.select("request_id", chosen["__run"].alias("run_id")).distinct(), "request_id", "left"
    )


def plan_backfill(ticks: DataFrame, runs: DataFrame, reset: bool = False) -> DataFrame:
    """Per tick of (dag_id, logical_date): create, skip or reset the run of that date."""
    named = ticks.withColumn(
        "run_id", make_run_id(F.lit("backfill"), F.col("dag_id"), F.col("logical_date"))
    )
    known = runs.select("dag_id", "run_id").distinct().withColumn("exists", F.lit(True))
    return named.join(known, ["dag_id", "run_id"], "left").withColumn(
        "action",
        F.when(F.col("exists").isNull(), "new").otherwise("reset" if reset else "skipped"),
    ).drop("exists")


def due_ticks(deployments: DataFrame, ticks: DataFrame, now) -> DataFrame:
    """Most recent tick strictly before `now`, where it still has to be fired.

    The latest tick is taken first and then checked against the window of the
    deployment and its last scheduled tick.
    """
    latest = ticks.filter(F.col("logical_date") < now).groupBy("deployment_id").agg(
        F.max("logical_date").alias("due_at")
    )
    due, last = F.col("due_at"), F.col("last_scheduled_at")
    return (
        deployments.filter(F.coalesce("enabled", F.lit(True)) & F.col("cron").isNotNull())
        .withColumnRenamed("id", "deployment_id")
        .join(latest, "deployment_id")
        .filter(F.col("start_date").isNull() | (due >= F.col("start_date")))
        .filter(F.col("end_date").isNull() | (due <= F.col("end_date")))
        .filter(last.isNull() | (due > last))
    )


def due_now(deployments: DataFrame, now) -> DataFrame:
    """`due_ticks` from the crons alone: the tick before `now` is searched for, no ticks are made.

    Deployments without a sound cron have none; `schedule.unscheduled` names them.
    """
    live = deployments.filter(F.coalesce("enabled", F.lit(True)) & F.col("cron").isNotNull()).withColumnRenamed("id", "deployment_id")
    found = schedule.neighbour_ticks(live, now, False, "due_at")
    due, last = F.col("due_at"), F.col("last_scheduled_at")
    return (
        found.filter(due.isNotNull())
        .filter(F.col("start_date").isNull() | (due >= F.col("start_date")))
        .filter(F.col("end_date").isNull() | (due <= F.col("end_date")))
        .filter(last.isNull() | (due > last))
    )


def attempt_logs(logs: DataFrame, requests: DataFrame) -> DataFrame:
    """Lines of the requested attempt, or of the latest one where none is named."""
    key = ["dag_id", "run_id", "task_id"]
    lines = logs.filter("source = 'task'").withColumn(
        "attempt", F.coalesce("attempt", F.lit(1)).cast("int")
    )
    # Narrow the lines first; the latest attempt is then a small aggregate.
    # A noisy task may hold very many lines, so its lines are spread.
    asked = requests.select(*key, F.col("attempt").alias("wanted_attempt")).distinct()
    wanted_lines = spread_join(lines, asked.select(*key).distinct(), key, "left_semi")
    latest = wanted_lines.groupBy(*key).agg(F.max("attempt").alias("latest_attempt"))
    chosen = asked.join(latest, key).select(
        *key, F.coalesce("wanted_attempt", "latest_attempt").cast("int").alias("attempt")
    ).distinct()
    return spread_join(lines, chosen, [*key, "attempt"], "left_semi")


def resume_view(
    tasks: DataFrame, runs: DataFrame, states: DataFrame, contexts: DataFrame
) -> DataFrame:
    """Every (run, task of its DAG) as a resumed run sees it."""
    base = runs.select("dag_id", "run_id").join(tasks.select("dag_id", "task_id").distinct(), "dag_id")
    seen = base.join(states.select(*_KEY, "state"), _KEY, "left").join(
        contexts.select(*_KEY, json_object(F.col("outputs")).alias("outputs")), _KEY, "left"
    )
    kept = is_terminal(F.col("state")) & (F.col("outputs") != "{}")
    return seen.select(
        *_KEY, F.coalesce("state", F.lit("none")).alias("state"),
        F.when(kept, F.col("outputs")).alias("outputs"),
    )


def deployment_diff(
    deployments: DataFrame, catalog: DataFrame, variables: DataFrame
) -> DataFrame:
    """What a sync would change; `variables` has (deployment_id, var_key, var_value, origin).

    Deployments that are up to date give one row without a variable.
    """
    versions = deployments.join(
        catalog.select("dag_id", F.col("version").alias("bundle_version")), "dag_id", "left"
    ).withColumn(
        "status",
        F.when(F.col("dag_version").eqNullSafe(F.col("bundle_version")), "up-to-date")
        .otherwise("stale"),
    )
    shown = variables.select(
        F.col("deployment_id").alias("id"), "var_key", "var_value",
        (F.col("origin") == "deployment").alias("is_override"),
        F.lit("stale").alias("status"),
    )
    return versions.join(shown, ["id", "status"], "left").select(
        "id", "dag_id", "pinned", "dag_version", "bundle_version", "status",
        "var_key", "var_value", "is_override",
    )


def run_report(runs: DataFrame, states: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per run a pass flag, and state, outputs and pass flag of each of its tasks."""
    return (
        runs.select("dag_id", "run_id", (F.col("state") == "success").alias("run_passed"))
        .join(states.select(*_KEY, "state"), ["dag_id", "run_id"])
        .join(contexts.select(*_KEY, json_object(F.col("outputs")).alias("outputs")), _KEY, "left")
        .select(
            *_KEY, "run_passed", "state",
            F.coalesce("outputs", F.lit("{}")).alias("outputs"),
            (F.col("state") == "success").alias("task_passed"),
        )
    )
