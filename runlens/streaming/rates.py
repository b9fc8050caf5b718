"""Rates of log lines in windows of time: over a table, as a stream, and as a table that a stream keeps.

Windows are aligned to the epoch and given in seconds. A sliding window is a run
of panes, as long as the greatest divisor of width and slide: lines are counted
once per pane, and only the counts are given out to the windows that hold the pane.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.streaming.sources import event_time

BY = ["level", "source"]


def _pane(width: int, slide: int) -> int:
    if not 0 < slide <= width:
        raise ValueError("a slide is at least one second and at most the width")
    return math.gcd(width, slide)


def _panes(logs: DataFrame, seconds: int) -> DataFrame:
    """Lines per pane, level and source; `pane` is the second it starts at. Lines without a time are in none."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    timed = logs.filter(F.col("ts").isNotNull()).withColumn("pane", at - F.pmod(at, F.lit(seconds)))
    return timed.groupBy("pane", *BY).agg(F.count(F.lit(1)).alias("lines"))


def _starts(width: int, slide: int) -> Column:
    """Starts of the windows that hold a pane."""
    last = F.col("pane") - F.pmod("pane", F.lit(slide))
    first = F.col("pane") + _pane(width, slide) - width  # a window that starts here ends with the pane
    first = first + F.pmod(-first, F.lit(slide))
    return F.when(first <= last, F.sequence(first, last, F.lit(slide).cast("long")))


def _moment(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def log_rates(logs: DataFrame, width: int, slide: int | None = None) -> DataFrame:
    """Lines per window, level and source, as (window_start, window_end, level, source, lines).

    Tumbling windows where no slide is given. A slide longer than the width is an error.
    """
    slide = slide or width
    counted = _panes(logs, _pane(width, slide)).withColumn("start", F.explode(_starts(width, slide)))
    return counted.groupBy("start", *BY).agg(F.sum("lines").alias("lines")).select(
        _moment(F.col("start")).alias("window_start"), _moment(F.col("start") + width).alias("window_end"), *BY, "lines"
    )


def stream_log_rates(logs: DataFrame, width: int, slide: int | None = None, delay: str = "1 minute") -> DataFrame:
    """The streaming form: a window's row comes when the watermark has passed its end.

    Lines that come later are dropped by Spark; `keep_log_rates` counts them as well.
    """
    span = F.window("ts", f"{width} seconds", f"{slide or width} seconds")
    timed = event_time(logs, "ts").withWatermark("ts", delay)
    return timed.groupBy(span.alias("span"), *BY).agg(F.count(F.lit(1)).alias("lines")).select(
        F.col("span.start").cast("timestamp_ntz").alias("window_start"), F.col("span.end").cast("timestamp_ntz").alias("window_end"),
        *BY, "lines",
    )


def keep_log_rates(
    logs: DataFrame, table: str, checkpoint: str, pane: int, delay: int = 60, once: bool = False
) -> StreamingQuery:
    """Append every batch's lines per pane to a table, with the watermark that held before the batch.

    The watermark is the newest time of all earlier batches less `delay` seconds, so a
    repeated batch finds the same one and writes the same folder again. A batch adds a
    row per pane, level and source, whatever its size; nothing written is read but the
    batches' newest times. Read the table with `read_log_rates`.
    """
    spark = logs.sparkSession

    def count(batch: DataFrame, batch_id: int) -> None:
        panes = _panes(batch.withColumn("ts", F.col("ts").cast("timestamp")), pane)
        newest = batch.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("newest"))
        before = _newest(spark, table, batch_id)
        mark = F.lit(None if before is None else before - delay).cast("long")
        panes.select("*", mark.alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{table}/panes/batch={batch_id}")
        newest.coalesce(1).write.mode("overwrite").parquet(f"{table}/newest/batch={batch_id}")

    writer = logs.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _newest(spark: SparkSession, table: str, before: int | None = None) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/newest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    times = spark.read.schema("newest long, batch long").parquet(f"{table}/newest")
    if before is not None:
        times = times.filter(F.col("batch") < before)
    return times.agg(F.max("newest")).first()[0]


def read_log_rates(spark: SparkSession, table: str, width: int, slide: int | None = None, pane: int | None = None, delay: int = 60) -> DataFrame:
    """Windows of the table: `lines` that came in time, `late_lines`, and whether the watermark has closed the window.

    A line is late for a window whose end the watermark had passed before its batch;
    with sliding windows it may be late for one and in time for the next. Width and
    slide are multiples of the pane that the table was kept with.
    """
    slide = slide or width
    if pane is not None and _pane(width, slide) % pane:
        raise ValueError("width and slide must be multiples of the table's pane")
    newest = _newest(spark, table)
    rows = spark.read.parquet(f"{table}/panes")
    whole = _pane(width, slide)
    wider = rows.withColumn("pane", F.col("pane") - F.pmod("pane", F.lit(whole))).groupBy("pane", "mark", *BY).agg(F.sum("lines").alias("lines"))
    late = F.coalesce(F.col("start") + width <= F.col("mark"), F.lit(False))
    counted = wider.withColumn("start", F.explode(_starts(width, slide))).groupBy("start", *BY).agg(
        F.sum(F.when(~late, F.col("lines")).otherwise(0)).alias("lines"), F.sum(F.when(late, F.col("lines")).otherwise(0)).alias("late_lines"),
    )
    return counted.select(
        _moment(F.col("start")).alias("window_start"), _moment(F.col("start") + width).alias("window_end"), *BY, "lines", "late_lines",
        (F.lit(newest) - delay >= F.col("start") + width).alias("closed"),
    )
