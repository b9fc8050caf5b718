"""Cron expansion for all deployments at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import cron as C
from runlens.functions.skew import spread_join
from runlens.session import cut_lineage

_PARSED = ("minutes", "hours", "days", "months", "weekdays", "seconds", "last_day", "workdays", "nth_weekdays")


def parse_cron(deployments: DataFrame) -> DataFrame:
    """Add the value arrays, the calendar's rules and `cron_status`; null where there is no cron."""
    parsed = deployments.withColumn("__cron", C.parse("cron"))
    return parsed.select(
        *deployments.columns,
        *[F.col(f"__cron.{name}").alias(f"cron_{name}") for name in _PARSED],
        F.col("__cron.day_or").alias("cron_day_or"),
        F.col("__cron.status").alias("cron_status"),
    )


def cron_ticks(
    deployments: DataFrame, start: Column, end: Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Ticks of each deployment in [start, end], as (deployment_id, .., logical_date).

    Deployments whose cron is not sound have none; `unscheduled` names them.
    Days are filtered before times are spread out. The deployments are dealt
    over all tasks before their days are searched, and the matching days once
    more: the table is small in bytes and would otherwise be searched, and
    expanded to all its ticks, inside a few tasks. The times of a day (86,400 at
    most) are one array, so that a tick is copied once and not once per field.
    """
    spark = deployments.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    days = (
        with_parsed(deployments.filter(F.col("cron").isNotNull()), parts=parts)
        .select(
            F.col("id").alias("deployment_id"), *keep,
            start.alias("__start"), end.alias("__end"), "__cron",
        )
        .filter((F.col("__cron.status") == "ok") & (F.col("__start") <= F.col("__end")))
        .select("*", F.explode(F.filter(
            F.sequence(F.to_date("__start"), F.to_date("__end")),
            lambda day: C.day_matches(day, F.col("__cron")),
        )).alias("__day"))
        .select(
            "deployment_id", *keep, "__start", "__end", "__day",
            F.col("__cron.hours").alias("__hours"), F.col("__cron.minutes").alias("__minutes"),
            F.col("__cron.seconds").alias("__seconds"),
        )
        .repartition(parts, "deployment_id", "__day")
    )
    times = F.flatten(F.transform("__hours", lambda hour: F.flatten(F.transform("__minutes", lambda minute: F.transform(
        "__seconds", lambda second: hour * 3600 + minute * 60 + second
    )))))
    return (
        days.select("deployment_id", *keep, "__start", "__end", "__day", F.explode(times).alias("__time"))
        .withColumn("logical_date", F.timestamp_add("SECOND", F.col("__time"), F.col("__day").cast("timestamp_ntz")))
        .filter(F.col("logical_date").between(F.col("__start"), F.col("__end")))
        .select("deployment_id", *keep, "logical_date")
    )


def unscheduled(deployments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deployments whose cron gives no ticks, as (deployment_id, .., cron, cron_status): invalid or unsupported."""
    return with_parsed(deployments).filter(F.col("__cron.status") != "ok").select(
        F.col("id").alias("deployment_id"), *keep, "cron", F.col("__cron.status").alias("cron_status")
    )


def with_parsed(rows: DataFrame, out: str = "__cron", parts: int | None = None) -> DataFrame:
    """Add the parsed cron to rows that repeat few cron texts: each text is parsed once.

    One text may stand in most rows, so the texts are joined by salted copies.
    With `parts` the rows are dealt evenly over that many tasks before.
    """
    texts = rows.select("cron").filter(F.col("cron").isNotNull()).distinct().withColumn(out, C.parse("cron"))
    dealt = rows if parts is None else rows.repartition(parts)
    return spread_join(dealt, texts, ["cron"], "left", few=True)


def neighbour_ticks(rows: DataFrame, at: Column, ahead: bool, out: str) -> DataFrame:
    """Add the cron's first tick after (or last tick before) a time of each row; null without a sound cron.

    The neighbour is searched for in the parsed fields: nothing is expanded, and a
    row needs no other row. A cron and a time that many rows share are searched once.
    Runs jobs when called.
    """
    timed = rows.withColumn("__at", at)
    # Both are written: the optimizer would push a filter on the tick through all steps of the search, or fold a
    # constant time into them, and undo their sharing.
    asked = cut_lineage(timed.select("cron", "__at").filter(F.col("cron").isNotNull() & F.col("__at").isNotNull()).distinct())
    found = cut_lineage(C.add_neighbour(with_parsed(asked), "__at", "__cron", ahead, out).drop("__cron"))
    return spread_join(timed, found, ["cron", "__at"], "left", copies=8).select(*rows.columns, out)


def catch_up_ticks(
    deployments: DataFrame, now: Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Missed runs of deployments that catch up and were never scheduled.

    The start date itself comes first, tick or not; then every tick after it
    before `now` and not after the end date.
    """
    waiting = deployments.filter(
        F.coalesce("enabled", F.lit(True)) & F.col("catch_up")
        & F.col("last_scheduled_at").isNull() & F.col("start_date").isNotNull()
    )
    never = with_parsed(waiting).filter(F.col("__cron.status") == "ok").drop("__cron")
    start = F.col("start_date")
    last = F.least(now, F.col("end_date"))
    held = tuple(dict.fromkeys([*keep, "start_date", "end_date"]))
    ticks = cron_ticks(never, start, last, held).filter(
        (F.col("logical_date") > start) & (F.col("logical_date") < now)
    )
    first = never.filter(
        (start < now) & (F.col("end_date").isNull() | (start <= F.col("end_date")))
    ).select(
        F.col("id").alias("deployment_id"), *[c for c in held], start.alias("logical_date")
    )
    return first.unionByName(ticks).select("deployment_id", *keep, "logical_date")
