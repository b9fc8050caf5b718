"""Writers. Spark's job commit makes each of them all-or-nothing per partition."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.skew import spread_join
from runlens.session import cut_lineage

LOG_FOLDERS = ("source", "dag_id", "run_id", "task_id", "attempt")


def route_logs(logs: DataFrame) -> DataFrame:
    """Add the folder of each line: task lines by identity, all else to framework."""
    is_task = F.col("source") == "task"
    for name in ("dag_id", "run_id", "task_id"):
        is_task = is_task & (F.coalesce(name, F.lit("")) != "")
    attempt = F.coalesce(F.nullif("attempt", F.lit(0)), F.lit(1))
    path = F.concat(
        F.concat_ws("/", "dag_id", "run_id", "task_id"),
        F.lit("/attempt_"), attempt.cast("string"), F.lit(".jsonl"),
    )
    return logs.withColumn("route", F.when(is_task, path).otherwise("framework.jsonl"))


def log_folders(logs: DataFrame) -> DataFrame:
    """Lines with a `__line` of JSON and the folder columns they are written under."""
    is_task = F.col("route") != "framework.jsonl"
    routed = route_logs(logs)
    line = F.to_json(F.struct(*logs.columns))
    attempt = F.coalesce(F.nullif("attempt", F.lit(0)), F.lit(1))
    return routed.select(
        line.alias("value"),
        F.when(is_task, "task").otherwise("framework").alias("source"),
        *[F.when(is_task, F.col(c)).alias(c) for c in ("dag_id", "run_id", "task_id")],
        F.when(is_task, attempt).alias("attempt"),
    )


def write_logs(logs: DataFrame, path: str, parts_per_task: int = 8) -> None:
    """Append lines under source/dag/run/task/attempt folders.

    Lines are clustered by folder so that each folder gets few files, and
    salted so that one noisy task spreads over `parts_per_task` writers.
    """
    salt = F.pmod(F.xxhash64("value"), F.lit(parts_per_task))
    (
        log_folders(logs).repartition(*LOG_FOLDERS, salt)
        .write.mode("append").partitionBy(*LOG_FOLDERS).text(path)
    )


def alert_records(events: DataFrame, at: str) -> DataFrame:
    """Lifecycle events as alert payloads: event and timestamp first, ids never null."""
    ids = {
        name: F.coalesce(name, F.lit("unknown")) if name in events.columns else F.lit("unknown")
        for name in ("dag_id", "task_id")
    }
    stamp = F.date_format(F.col(at), "yyyyMMdd_HHmmss_SSSSSS").alias("timestamp")
    rest = [name for name in events.columns if name not in ("event", "timestamp")]
    return events.withColumns(ids).select("event", stamp, *dict.fromkeys([*ids, *rest]))


def write_alerts(alerts: DataFrame, path: str) -> None:
    """One JSON object per alert record."""
    alerts.write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the records of the partitions `df` touches; the others stay."""
    (
        df.repartition(*keys).write.mode("overwrite").partitionBy(*keys)
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )




def with_file(df: DataFrame, keys: list[str], size: Column, target: int) -> tuple[DataFrame, int]:
    """Add `__file`, the file within its folder that a row goes to, and give the number of files in all.

    The folders (values of `keys`) are weighed first: a folder gets one file per
    `target` of the sum of `size`, and its rows are dealt to them by hash, so a hot
    folder is written by many tasks and a small one by one. A row meets the weight of
    its folder by salted copies, as a folder may hold most rows.
    """
    weighed = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / target)).alias("__files"))
    files = cut_lineage(weighed)  # one row per folder
    plain = [F.col(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    dealt = spread_join(df, files, keys).withColumn(
        "__file", F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.col("__files")).cast("int")
    ).drop("__files")
    return dealt, int(files.agg(F.sum("__files")).first()[0] or 0)


def log_table(logs: DataFrame, buckets: int) -> DataFrame:
    """Log lines as rows of a table laid out by day and by a hash of the attempt they belong to.

    Lines need `ts` (a time) and the identity columns; those of the framework are one
    identity. Lines without a time go to the day 1970-01-01.
    """
    routed = route_logs(logs)
    day = F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return routed.withColumns({"day": day, "bucket": F.pmod(F.xxhash64("route"), F.lit(buckets)).cast("int")})


def write_log_table(
    logs: DataFrame, path: str, buckets: int = 64, file_bytes: int = 128 << 20, batch: int | None = None
) -> None:
    """Append lines under day=/bucket= folders: as many folders as buckets a day, however many attempts.

    Files are sized from the bytes of the messages counted first, and sorted by
    attempt and time, so that a reader of one attempt opens one folder a day and few
    row groups in it. With `batch` the lines go to a folder of that batch below each
    bucket and replace what an earlier try of the batch wrote.
    """
    keys = ["day", "bucket"]
    size = F.lit(64) + F.octet_length(F.coalesce("msg", F.lit("")).cast("string"))
    dealt, files = with_file(log_table(logs, buckets), keys, size, file_bytes)
    if not files:
        return
    own = [] if batch is None else ["batch"]
    rows = dealt if batch is None else dealt.withColumn("batch", F.lit(batch).cast("long"))
    (
        rows.repartition(files, *keys, "__file").sortWithinPartitions(*keys, "__file", "route", "ts").drop("__file")
        .write.mode("append" if batch is None else "overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys, *own).parquet(path)
    )


def read_log_table(spark, path: str, dag_id: str | None, run_id: str | None, task_id: str | None, attempt: int = 1, buckets: int = 64) -> DataFrame:
    """Lines of one attempt (of the framework where the ids are null), from the one bucket of each day that holds them."""
    one = spark.createDataFrame([("task", dag_id, run_id, task_id, attempt)], "source string, dag_id string, run_id string, task_id string, attempt int")
    route, bucket = route_logs(one).select("route", F.pmod(F.xxhash64("route"), F.lit(buckets)).cast("int")).first()
    return spark.read.parquet(path).filter((F.col("bucket") == bucket) & (F.col("route") == route))


def write_partitions(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 1_000_000) -> None:
    """Replace the records of the partitions `df` touches, as `write_snapshot`; a hot partition is split over several files."""
    dealt, files = with_file(df, keys, F.lit(1), rows_per_file)
    if files:
        (
            dealt.repartition(files, *keys, "__file").drop("__file").write.mode("overwrite").partitionBy(*keys)
            .option("partitionOverwriteMode", "dynamic").parquet(path)
        )
