"""Metrics over a whole fleet: totals, durations as histograms and mergeable sketches, queue depth over time.

No metric is labelled by DAG or run, so the results stay small however large the fleet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import blocks

#: Size of a quantile sketch, and the error of its ranks that it stays under (a share of all values).
SKETCH_SIZE, RANK_ERROR = 800, 0.01
#: Upper bounds of duration buckets, in seconds.
DURATION_BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
DEPTH_STEP = 3600


def state_totals(rows: DataFrame, state: str = "state") -> DataFrame:
    """Rows per state."""
    return rows.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("total"))


def duration_histogram(
    attempts: DataFrame, value: str = "duration", by: tuple[str, ...] = ("state",), bounds: tuple[float, ...] = DURATION_BOUNDS
) -> DataFrame:
    """Cumulative buckets: (by, le, n), `le` null for the bucket without bound, where n counts all values.

    Each value falls into its bucket as it is read; a group's few counts are summed up
    afterwards. Null values are in no bucket; a group without values has no rows.
    """
    edges = F.array(*[F.lit(float(b)) for b in sorted(bounds)])
    slot = F.size(F.filter(edges, lambda edge: edge < F.col(value)))
    slots = attempts.filter(F.col(value).isNotNull()).groupBy(*by, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    grouped = slots.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("counts"))  # <= bounds + 1
    upto = F.transform(
        F.sequence(F.lit(0), F.lit(len(bounds))),
        lambda i: F.struct(
            F.get(edges, i).alias("le"),
            F.aggregate(
                F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda total, j: total + F.coalesce(F.try_element_at("counts", j), F.lit(0))
            ).alias("n"),
        ),
    )
    return grouped.select(*by, F.inline(upto))


def duration_sketches(attempts: DataFrame, by: list[str], value: str = "duration") -> DataFrame:
    """A quantile sketch of `value` per group, as (by, sketch, n): partial results that can be stored and merged.

    Sketches are built on the map side and merged by the shuffle, so a hot group moves
    one sketch per task.
    """
    return attempts.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Coarser groups from finer ones, such as a month from its days, without the values."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(by, share, quantile, n): a quantile's rank is within RANK_ERROR of its share."""
    found = F.array(*[
        F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias("quantile")) for s in shares
    ])
    return sketches.select(*by, F.inline(found), "n")


def queue_depth(
    spans: DataFrame, keys: tuple[str, ...] = ("queue",), step: int = DEPTH_STEP, start: str = "queued_at", end: str = "ended_at"
) -> DataFrame:
    """How many spans were open in each step of time: (keys, at, opened, closed, peak, depth).

    A span adds one when it starts and takes one away when it ends; the depth is the
    running sum. At one instant ends count before starts. `peak` is the largest depth
    in the step, `depth` the one at its end; steps without a change have no row. A
    span without an end stays open; one without a start, or that ends before it
    starts, is left out.

    The sum runs within (key, step) and is carried from step to step by one row
    each, so a queue that holds everything is spread over the steps.
    """
    sound = spans.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    changes = sound.select(
        *keys, F.explode(F.array(
            F.struct(F.col(start).alias("moment"), F.lit(1).cast("long").alias("change")),
            F.struct(F.col(end).alias("moment"), F.lit(-1).cast("long").alias("change")),
        )).alias("c"),
    ).select(*keys, "c.*").filter(F.col("moment").isNotNull())
    # equal instants of a key are one change down and one up, so that a busy instant is one row
    netted = changes.groupBy(*keys, "moment").agg(
        F.count_if(F.col("change") > 0).alias("opened"), F.count_if(F.col("change") < 0).alias("closed")
    )
    cut = blocks.with_block(netted, "moment", step)
    per_step = Window.partitionBy(*keys, "__block").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn("level", F.sum(F.col("opened") - F.col("closed")).over(per_step))
    steps = inner.groupBy(*keys, "__block").agg(
        F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), F.max("level").alias("__peak")
    )
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("opened") - F.col("closed")).over(earlier), F.lit(0))
    return steps.withColumn("__before", before).select(
        *keys, F.timestamp_seconds(F.col("__block") * step).cast("timestamp_ntz").alias("at"), "opened", "closed",
        (F.col("__before") + F.greatest(F.lit(0), "__peak")).alias("peak"),
        (F.col("__before") + F.col("opened") - F.col("closed")).alias("depth"),
    )


def fleet_metrics(runs: DataFrame, attempts: DataFrame, spans: DataFrame) -> DataFrame:
    """The counters of a fleet as (metric, label, value): runs and attempts by state, buckets of durations, queue depth now."""
    def rows(metric, df, label, value):
        return df.select(F.lit(metric).alias("metric"), label.cast("string").alias("label"), value.cast("double").alias("value"))

    total, n = F.col("total"), F.col("n")
    last = queue_depth(spans).groupBy("queue").agg(F.max_by("depth", "at").alias("total"))
    edge = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    out = rows("dag_runs_total", state_totals(runs), F.col("state"), total)
    for more in (
        rows("task_attempts_total", state_totals(attempts), F.col("state"), total),
        rows("task_attempt_duration_seconds_bucket", duration_histogram(attempts, by=()), edge, n),
        rows("task_attempt_duration_seconds_sum", attempts.agg(F.sum("duration").alias("total")), F.lit(""), F.round(total, 3)),
        rows("queue_depth", last, F.col("queue"), total),
    ):
        out = out.unionByName(more)
    return out
