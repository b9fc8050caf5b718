"""Retention: what of a partitioned table is past its time, and its removal.

A partition whose rows are all past their time is dropped by name, without
reading it; one that holds both is rewritten; the others are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch
from runlens.values import TERMINAL_STATES

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def run_expired(now: Column, keep_days: int) -> Column:
    """Whether a run has ended, and did so more than `keep_days` days before `now`. A live run never is; nor is one
    whose end is unknown."""
    ended = F.col("state").isin(*TERMINAL_STATES) & F.col("ended_at").isNotNull()
    return F.coalesce(ended & (F.col("ended_at") < now - F.make_dt_interval(F.lit(keep_days))), F.lit(False))


def purge_plan(rows: DataFrame, keys: list[str], expired: Column) -> DataFrame:
    """The dry run, one row per partition: (keys, kept, purged, action), action being `drop`, `rewrite` or `keep`."""
    counts = rows.groupBy(*keys).agg(F.count_if(~expired).alias("kept"), F.count_if(expired).alias("purged"))
    return counts.withColumn(
        "action", F.when(F.col("purged") == 0, "keep").when(F.col("kept") == 0, "drop").otherwise("rewrite")
    )


def purge_runs(runs: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """The runs that would go."""
    return runs.filter(run_expired(now, keep_days))


def purge_records(records: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("dag_id", "run_id")) -> DataFrame:
    """Records of runs (states, contexts, logs) without those of the runs that go."""
    return records.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def _drop_folders(spark: SparkSession, path: str, keys: list[str], names: list) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in names:
        parts = [f"{k}={NO_VALUE if row[k] in (None, '') else escape(str(row[k]))}" for k in keys]
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, "/".join(parts)), True)


def purge_table(spark: SparkSession, path: str, keys: list[str], expired: Column, dry_run: bool = True) -> DataFrame:
    """Remove the rows past their time from a Parquet table partitioned by `keys`; returns the plan.

    Rewritten partitions are first written to the shared folder and then replace the
    old ones, so a run that is stopped leaves every row that stays in one place or the
    other, and can be started again. Only names of partitions come to the driver, a
    thousand at a time. With `dry_run` nothing is changed.
    """
    rows = spark.read.parquet(path)
    plan = purge_plan(rows, keys, expired)
    held = f"{scratch(spark)}/purge-{uuid.uuid4().hex}"
    plan.write.parquet(f"{held}/plan")
    plan = spark.read.schema(plan.schema).parquet(f"{held}/plan")
    if dry_run:
        return plan
    stay, mixed = rows.filter(~expired), plan.filter("action = 'rewrite'").select(*keys)
    stay = stay.join(mixed, [stay[k].eqNullSafe(mixed[k]) for k in keys], "left_semi")
    stay.write.parquet(f"{held}/rows")
    copied = spark.read.schema(stay.schema).parquet(f"{held}/rows")
    copied.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    some = []
    for row in plan.filter("action = 'drop'").select(*keys).toLocalIterator():
        some.append(row)
        if len(some) == 1000:
            _drop_folders(spark, path, keys, some)
            some = []
    _drop_folders(spark, path, keys, some)
    return plan


def expire_plan(logs: DataFrame, now: Column, max_age_days: int, at: str = "ts") -> DataFrame:
    """Days of log lines and whether they go: (day, lines, expired). A day goes when it ended before the age limit."""
    day = F.to_date(at)
    edge = F.to_date(now - F.make_dt_interval(F.lit(max_age_days)))
    return logs.filter(F.col(at).isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("lines")).withColumn(
        "expired", F.col("day") < edge
    )


def expire_logs(spark: SparkSession, path: str, now: str, max_age_days: int, dry_run: bool = True) -> list[str]:
    """Drop the day= folders of a log table that are past `max_age_days` before the date `now`; returns their names.

    Only folder names are read. Folders that are no days stay.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    days = [(n.removeprefix("day="),) for n in names if n.startswith("day=")]
    if not days:
        return []
    edge = F.date_sub(F.lit(now).cast("date"), max_age_days)
    old = spark.createDataFrame(days, "day string").filter(F.col("day").try_cast("date") < edge).orderBy("day")
    gone = [f"day={r[0]}" for r in old.collect()]
    if not dry_run:
        for name in gone:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    return gone
