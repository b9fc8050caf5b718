"""Winners, numbering and neighbours.

Winners are aggregates (`min_by`, `max_by`), not windows: the aggregate
shrinks a hot key before the shuffle. Where every row needs an answer, it goes
through `functions.blocks`, which splits a hot key into blocks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import blocks
from runlens.functions.skew import spread_join
from runlens.operators import schedule
from runlens.values import LEGAL_TRANSITIONS

TASK_KEY = ["dag_id", "run_id", "task_id"]


def current_states(
    events: DataFrame, order: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Last write per key of an append-only event log.

    `order` ought to be a total order per key; equal ranks fall back on the
    other columns, so the answer is the same on every run.
    """
    keys = keys or TASK_KEY
    held = [name for name in events.columns if name not in keys]
    ranked = [*order, *[name for name in held if name not in order]]
    row = F.struct(*ranked)
    # Maps have no order; a column that holds one is ranked by its sorted entries, or its JSON text if it lies deeper.
    kinds = {field.name: field.dataType.simpleString() for field in events.schema.fields}

    def sortable(name: str):
        if "map<" not in kinds[name]:
            return F.col(name)
        flat = kinds[name].startswith("map<") and kinds[name].count("map<") == 1
        return F.array_sort(F.map_entries(name)) if flat else F.to_json(name)

    mapped = any("map<" in kinds[name] for name in ranked)
    newest = F.max_by(row, F.struct(*map(sortable, ranked))) if mapped else F.max(row)
    return events.groupBy(*keys).agg(newest.alias("__row")).select(*keys, *[f"__row.{name}" for name in held])


def latest_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return current_states(attempts, ["attempt_number"], keys)


def number_attempts(starts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return blocks.numbered(starts, keys, order, "attempt_number")


def dedup_scheduled_runs(
    candidates: DataFrame, order: list[str], keys: list[str] | None = None
) -> DataFrame:
    """First creator per key wins; the others learn the winner's run id.

    The default key is (dag_id, logical date to the second). A candidate
    without a logical date is always created. Candidates that `order` leaves
    equal are told apart by their run id, and by all columns after that.
    """
    keys = keys or ["dag_id", "logical_second"]
    dated = candidates.withColumn("logical_second", F.date_trunc("second", "logical_date"))
    dated = dated.withColumn("logical_second", F.col("logical_second").cast("timestamp_ntz"))
    scheduled = dated.filter(F.col("logical_date").isNotNull())
    plain = [f.name for f in scheduled.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rank = list(dict.fromkeys([*order, "run_id", *plain]))
    rivals = {"actual_run_id": "run_id"} | {f"__{column}": column for column in rank}
    known = blocks.with_first(scheduled, keys, rank, rivals)
    same = F.lit(True)
    for column in rank:
        same = same & F.col(column).eqNullSafe(F.col(f"__{column}"))
    decided = known.select(*candidates.columns, same.alias("created"), "actual_run_id")
    manual = candidates.filter(F.col("logical_date").isNull()).select(
        *candidates.columns, F.lit(True).alias("created"),
        F.col("run_id").alias("actual_run_id"),
    )
    return decided.unionByName(manual)


def claim_triggers(claims: DataFrame, order: list[str]) -> DataFrame:
    """First claimer per trigger: (trigger_id, claimed_by, claimed_at); ties go to the smaller instance id."""
    first = F.min_by(F.struct("instance_id", "claimed_at"), F.struct(*order, "instance_id", "claimed_at"))
    return claims.groupBy("trigger_id").agg(first.alias("__c")).select(
        "trigger_id", F.col("__c.instance_id").alias("claimed_by"),
        F.col("__c.claimed_at").alias("claimed_at"),
    )


def drained_by_instance(claims: DataFrame, order: list[str]) -> DataFrame:
    """How many triggers each instance drained."""
    return claim_triggers(claims, order).groupBy("claimed_by").agg(
        F.count(F.lit(1)).alias("drained")
    )


def claim_ticks(updates: DataFrame) -> DataFrame:
    """Accept an update iff it is later than every update that arrived before.

    Columns: deployment_id, proposed_at, arrival_seq (a total order per
    deployment).
    """
    seen = blocks.running_max_before(
        updates, ["deployment_id"], ["arrival_seq"], "proposed_at", "accepted_before"
    )
    later = F.col("proposed_at") > F.col("accepted_before")
    return seen.withColumn("accepted", F.col("accepted_before").isNull() | later)


def admit_under_limit(ticks: DataFrame, deployments: DataFrame, active: DataFrame) -> DataFrame:
    """Oldest ticks first, up to `max_active_runs` minus the active runs.

    Ticks beyond the limit stay in the result as deferred.
    """
    placed = blocks.numbered(ticks, ["deployment_id"], ["logical_date"], "queue_position")
    limits = (
        deployments.select(F.col("id").alias("deployment_id"), "max_active_runs")
        .join(active, "deployment_id", "left")
        .select(
            "deployment_id",
            (F.col("max_active_runs") - F.coalesce("active_runs", F.lit(0))).alias("budget"),
        )
    )
    admitted = F.col("budget").isNull() | (F.col("queue_position") <= F.col("budget"))
    return spread_join(placed, limits, ["deployment_id"], "left").withColumn("admitted", admitted)


def deferred_counts(admission: DataFrame) -> DataFrame:
    return admission.groupBy("deployment_id").agg(
        F.count_if("admitted").alias("admitted"),
        F.count_if(~F.col("admitted")).alias("deferred"),
    )


def audit_transitions(
    events: DataFrame, order: list[str], keys: list[str] | None = None,
    legal: tuple = LEGAL_TRANSITIONS,
) -> DataFrame:
    """Each consecutive pair of states of a task, checked against the legal table."""
    keys = keys or TASK_KEY
    pairs = blocks.neighbour(events, keys, order, {"from_state": "state"}).filter(
        F.col("from_state").isNotNull()
    )
    step = F.concat_ws(">", "from_state", "state")
    return pairs.select(
        *keys, *order, "from_state", F.col("state").alias("to_state"),
        step.isin([f"{old}>{new}" for old, new in legal]).alias("is_legal"),
    )


def data_intervals(ticks: DataFrame) -> DataFrame:
    """Interval of every tick: from the tick to the next tick of its cron.

    The next tick is searched for in the cron, so the last one has an end as well and
    no row needs another. Without a cron both ends are the logical date; with one
    that is invalid or unsupported the end is null. Columns `interval_start`
    and `interval_end`, where present and not null, win.
    """
    following = schedule.neighbour_ticks(ticks, F.col("logical_date"), True, "__next")
    end = F.when(F.col("cron").isNull(), F.col("logical_date")).otherwise(F.col("__next"))
    start = F.col("logical_date")
    if "interval_start" in ticks.columns:
        start = F.coalesce("interval_start", start)
    if "interval_end" in ticks.columns:
        end = F.coalesce("interval_end", end)
    return following.select(
        *[c for c in ticks.columns if c not in ("interval_start", "interval_end")],
        start.alias("data_interval_start"), end.alias("data_interval_end"),
    )
