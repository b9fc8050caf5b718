"""Every scheduled firing of a day, as one plan."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.states import make_run_id
from runlens.operators import schedule
from runlens.operators.windows import admit_under_limit, dedup_scheduled_runs
from runlens.session import cut_lineage

_HELD = ("dag_id", "start_date", "end_date", "last_scheduled_at")


def schedule_day(
    deployments: DataFrame, day_start: Column, day_end: Column, active: DataFrame,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Firings of enabled deployments in [day_start, day_end).

    Deployments that catch up and were never scheduled bring all missed runs.
    Firings of one DAG for the same second are created once; what was created
    is then admitted oldest first under each deployment's limit. A firing whose
    DAG has a run in `runs` for that second is created already. An enabled deployment
    whose cron gives no ticks has one row without a date, with the verdict
    `invalid_cron` or `unsupported_cron`.
    """
    enabled = deployments.filter(F.coalesce("enabled", F.lit(True)))
    catching = F.col("catch_up") & F.col("last_scheduled_at").isNull() & F.col("start_date").isNotNull()
    usual = enabled.filter(~F.coalesce(catching, F.lit(False)))
    tick = F.col("logical_date")
    ticks = schedule.cron_ticks(usual, day_start, day_end, _HELD).filter(
        (tick < day_end)
        & (F.col("start_date").isNull() | (tick >= F.col("start_date")))
        & (F.col("end_date").isNull() | (tick <= F.col("end_date")))
        & (F.col("last_scheduled_at").isNull() | (tick > F.col("last_scheduled_at")))
    )
    missed = schedule.catch_up_ticks(enabled, day_end, _HELD)
    named = ticks.unionByName(missed).select(
        "deployment_id", "dag_id", "logical_date",
        make_run_id(F.lit("scheduled"), F.col("dag_id"), tick).alias("run_id"),
    )
    if runs is None:
        named = named.withColumn("__there", F.lit(None).cast("boolean"))
    else:
        second = F.date_trunc("second", "logical_date").cast("timestamp_ntz").alias("__second")
        dated = runs.filter(F.col("logical_date").isNotNull()).select("dag_id", second).distinct()
        named = named.select("*", second).join(
            dated.withColumn("__there", F.lit(True)), ["dag_id", "__second"], "left"
        ).drop("__second")
    # The firings feed the deduplication and the admission several times over;
    # marked and written once, they are expanded from cron once.
    firings = cut_lineage(named)
    decided = dedup_scheduled_runs(firings.filter(F.col("__there").isNull()).drop("__there"), ["deployment_id"])
    created = decided.filter("created").drop("created", "actual_run_id")
    admitted = admit_under_limit(created, deployments, active).select(
        "deployment_id", "dag_id", "logical_date", "run_id",
        F.when(F.col("admitted"), "fired").otherwise("deferred").alias("verdict"),
    )
    lost = decided.filter(~F.col("created")).select(
        "deployment_id", "dag_id", "logical_date", "run_id",
        F.lit("already_created").alias("verdict"),
    )
    lost_to_runs = firings.filter("__there").select(
        "deployment_id", "dag_id", "logical_date", "run_id", F.lit("already_created").alias("verdict")
    )
    without = schedule.unscheduled(enabled, ("dag_id",)).select(
        "deployment_id", "dag_id", F.lit(None).cast("timestamp_ntz").alias("logical_date"), F.lit(None).cast("string").alias("run_id"),
        F.concat("cron_status", F.lit("_cron")).alias("verdict"),
    )
    return admitted.unionByName(lost).unionByName(lost_to_runs).unionByName(without)
