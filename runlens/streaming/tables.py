"""Streams that keep tables, alerts and logs up to date."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.functions import states as S
from runlens.operators.filters import tag_logs
from runlens.operators.windows import current_states
from runlens.sources import sinks


#: A batch whose largest bucket has more than so many times the mean of all buckets holds a key with many rows.
UNEVEN = 2


def stream_current_states(
    events: DataFrame, table: str, checkpoint: str, keys: list[str],
    order: list[str], buckets: int = 32, once: bool = False,
) -> StreamingQuery:
    """Keep the last write per key in a Parquet table; see `stream_winners`."""
    return stream_winners(
        events, table, checkpoint, keys, lambda rows, by: current_states(rows, order, by), buckets, once
    )


def stream_winners(
    events: DataFrame, table: str, checkpoint: str, keys: list[str],
    choose: Callable[[DataFrame, list[str]], DataFrame], buckets: int = 32, once: bool = False,
) -> StreamingQuery:
    """Keep one row per key in a Parquet table: `choose(rows, keys)` picks it from the old one and the new ones.

    The table is cut into hash buckets of the key. A batch rewrites only the
    buckets it touches, each from its own old rows and the new ones, into a
    folder named after the batch; readers take the newest folder per bucket
    through `read_current_states`. A repeated batch writes the same folders. A
    query with a new checkpoint numbers its batches after those of the table.
    """
    spark = events.sparkSession
    base = _first_version(spark, table, checkpoint)

    def merge(batch: DataFrame, batch_id: int) -> None:
        version = base + batch_id
        batch.persist()
        try:
            bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
            fresh = batch.withColumn("bucket", bucket.cast("int"))
            hit = dict(tuple(row) for row in fresh.groupBy("bucket").count().collect())  # <= buckets
            if not hit:
                return
            if max(hit.values()) * buckets > UNEVEN * sum(hit.values()):
                fresh = choose(fresh, [*keys, "bucket"])  # thinned where they lie, so that no task gets all rows of a key
            old = _versions(spark, table, before=version)
            if old is not None:
                kept = old.filter(F.col("bucket").isin(list(hit))).drop("version")
                fresh = kept.unionByName(fresh)
            # one shuffle by bucket serves the choice, whose keys include it, and the writing
            newest = choose(fresh.repartition("bucket"), [*keys, "bucket"])
            newest.withColumn("version", F.lit(version)).write.mode(
                "overwrite"
            ).option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(table)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _files(spark, path: str):
    """The path and its file system, as Spark's own writers see them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _written_versions(spark, table: str) -> list[int]:
    path, files = _files(spark, table)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return [int(name.removeprefix("version=")) for name in names if name.startswith("version=")]


def _first_version(spark, table: str, checkpoint: str) -> int:
    """Version of batch 0 of a checkpoint: noted beside it when it is first used."""
    marks, files = _files(spark, f"{checkpoint}.first=*")
    noted = files.globStatus(marks)
    if noted:
        return int(noted[0].getPath().getName().rpartition("=")[2])
    known = files.exists(_files(spark, checkpoint)[0])
    first = 0 if known else max(_written_versions(spark, table), default=-1) + 1
    files.create(_files(spark, f"{checkpoint}.first={first}")[0]).close()
    return first


def _versions(spark, table: str, before: int | None = None) -> DataFrame | None:
    """Rows of the newest version of every bucket, older than `before`; None if there is no version yet.

    Whatever else goes wrong with reading the table is an error.
    """
    if not any(before is None or version < before for version in _written_versions(spark, table)):
        return None
    rows = spark.read.parquet(table)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    # One row per bucket; only the partition columns are read for it.
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi")


def read_current_states(spark, table: str) -> DataFrame:
    return _versions(spark, table).drop("bucket", "version")


def lifecycle_events(events: DataFrame) -> DataFrame:
    """Task state changes as lifecycle events; other states raise none."""
    state = F.col("state")
    event = (
        F.when(state == "running", "start").when(state == "success", "success")
        .when(state == "failed", "failure").when(state == "up_for_retry", "retry")
        .when(state == "skipped", "skipped")
    )
    return events.withColumn("event", event).filter(F.col("event").isNotNull())


def run_lifecycle_events(runs: DataFrame) -> DataFrame:
    """Run state changes as events; an ended run raises its outcome and `finished`."""
    state = F.col("state")
    raised = (
        F.when(state == "running", F.array(F.lit("start")))
        .when(state == "success", F.array(F.lit("success"), F.lit("finished")))
        .when(state == "failed", F.array(F.lit("failure"), F.lit("finished")))
    )
    return runs.select("*", F.explode(raised).alias("event"))


def match_hooks(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Lifecycle events joined to the hooks registered for them.

    `hooks` has (dag_id, [task_id,] event, hook) and is static.
    """
    keys = [c for c in ("dag_id", "task_id", "event") if c in hooks.columns]
    return events.join(hooks, keys)


def stream_alerts(
    events: DataFrame, hooks: DataFrame, path: str, checkpoint: str, at: str = "updated_at"
) -> StreamingQuery:
    """Write one JSON alert per matching event; `at` is the time of the event."""
    return (
        sinks.alert_records(match_hooks(lifecycle_events(events), hooks), at)
        .writeStream.format("json").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_logs(
    records: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Tag raw records and append them to the log folders, each line exactly once."""
    tagged = tag_logs(records).withColumn("extra", F.to_json("extra"))
    writer = (
        sinks.log_folders(tagged).writeStream.format("text")
        .partitionBy(*sinks.LOG_FOLDERS).option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def stream_log_table(
    records: DataFrame, path: str, checkpoint: str, buckets: int = 64, file_bytes: int = 128 << 20, once: bool = False
) -> StreamingQuery:
    """Append the lines of every batch to the table of `sinks.write_log_table`, each line exactly once.

    `records` has the columns of log lines with `ts` as a time. A batch writes
    at most one folder per day and bucket it has lines of, and a batch that is
    repeated replaces its own folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sinks.write_log_table(batch, path, buckets, file_bytes, batch_id)
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_retries(contexts: DataFrame) -> DataFrame:
    """Tasks to run again, and when: the end of the last attempt plus the delay.

    Works on a stream and on a table alike; nothing is shuffled.
    """
    made = F.size("attempts")
    last = F.try_element_at("attempts", F.lit(-1))
    delay = S.next_retry_delay(made, F.col("retry_delay"), F.col("exponential_backoff"))
    ended = last["ended_at"]
    due = F.timestamp_add("MICROSECOND", (delay * 1e6).cast("long"), ended)
    return contexts.filter(
        S.settled_state(last["state"], made, F.col("retries")) == "up_for_retry"
    ).select(
        "dag_id", "run_id", "task_id", made.alias("attempts_made"),
        due.cast("timestamp_ntz").alias("due_at"),
    )


def on_batch(
    events: DataFrame, hooks: list[Callable[[DataFrame, int], None]], checkpoint: str
) -> StreamingQuery:
    """Call user hooks with every micro-batch of events; one hook's error does not
    keep the others from running, but it fails the query at the end of the batch."""

    def call(batch: DataFrame, batch_id: int) -> None:
        errors = []
        for hook in hooks:
            try:
                hook(batch, batch_id)
            except Exception as error:  # noqa: BLE001 - hooks are user code
                errors.append(error)
        if errors:
            raise ExceptionGroup("hooks failed", errors)

    return (
        events.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
