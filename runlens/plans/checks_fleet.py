"""Queries over rates and metrics, and streams replayed from the tables."""

import uuid

from pyspark.sql import functions as F

from runlens.operators import metrics
from runlens.plans.checks import check
from runlens.session import scratch
from runlens.streaming import claims, rates, replay, tables, zombies

# Lots by age, eight days each; every fiftieth line comes a lot late.
LOTS = 4
_AGE = "CAST(floor((dayofmonth(ts) - 1) / 8) AS BIGINT)"
LATE_LOT = f"least({LOTS - 1}, {_AGE} + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END)"


def _folder(h, name):
    """A new folder for a table that a stream keeps."""
    return f"{scratch(h.spark)}/{name}-{uuid.uuid4().hex}"


@check("opt6_log_rates", """
    WITH w AS (SELECT level, source, CAST(floor(epoch(ts)) AS BIGINT) AS s, unnest(range(0, 4)) AS k FROM {fx_logs}),
    starts AS (SELECT level, source, s - s % 900 - k * 900 AS start FROM w)
    SELECT make_timestamp(start * 1000000) AS window_start, make_timestamp((start + 3600) * 1000000) AS window_end,
           level, source, count(*) AS lines
    FROM starts GROUP BY start, level, source""")
def _(h):
    return rates.log_rates(h.fx_logs, 3600, 900)


@check("opt6_log_rate_stream", f"""
    WITH a AS (SELECT level, source, CAST(floor(epoch(ts)) AS BIGINT) AS s, {LATE_LOT} AS lot FROM {{fx_logs}}),
    marks AS (SELECT l.lot, (SELECT max(s) - 60 FROM a WHERE a.lot < l.lot) AS mark FROM (SELECT DISTINCT lot FROM a) l),
    w AS (SELECT level, source, mark, s - s % 3600 - k * 3600 AS start
          FROM (SELECT *, unnest([0, 1]) AS k FROM a JOIN marks USING (lot)))
    SELECT make_timestamp(start * 1000000) AS window_start, make_timestamp((start + 7200) * 1000000) AS window_end, level, source,
           count(*) FILTER (mark IS NULL OR start + 7200 > mark) AS lines, count(*) FILTER (start + 7200 <= mark) AS late_lines,
           start + 7200 <= (SELECT max(s) - 60 FROM a) AS closed
    FROM w GROUP BY start, level, source""")
def _(h):
    table = _folder(h, "rates")
    replay.replay(
        h.fx_logs, F.expr(LATE_LOT), LOTS,
        lambda logs, checkpoint: rates.keep_log_rates(logs, table, checkpoint, 3600, 60, once=True),
    )
    return rates.read_log_rates(h.spark, table, 7200, 3600, 3600, 60)


_BOUNDS = "[" + ", ".join(str(b) for b in metrics.DURATION_BOUNDS) + "]"


@check("opt2_fleet_metrics", f"""
    WITH depth AS (SELECT queue, count(queued_at) - count(ended_at) AS n FROM {{fx_spans}} GROUP BY queue),
    edges AS (SELECT unnest({_BOUNDS}::DOUBLE[]) AS le)
    SELECT 'dag_runs_total' AS metric, state AS label, CAST(count(*) AS DOUBLE) AS value FROM {{fx_runs}} GROUP BY state
    UNION ALL SELECT 'task_attempts_total', state, count(*) FROM {{fx_spans}} GROUP BY state
    UNION ALL SELECT 'task_attempt_duration_seconds_bucket', CAST(le AS VARCHAR), (SELECT count(*) FROM {{fx_spans}} WHERE duration <= le) FROM edges
    UNION ALL SELECT 'task_attempt_duration_seconds_bucket', '+Inf', count(duration) FROM {{fx_spans}}
    UNION ALL SELECT 'task_attempt_duration_seconds_sum', '', round(sum(duration), 3) FROM {{fx_spans}}
    UNION ALL SELECT 'queue_depth', queue, n FROM depth""")
def _(h):
    return metrics.fleet_metrics(h.fx_runs, h.fx_spans, h.fx_spans)


@check("opt2_duration_histogram", f"""
    SELECT state, e.le, count(*) FILTER (duration <= coalesce(e.le, 'infinity'::DOUBLE)) AS n
    FROM {{fx_spans}}, (SELECT unnest({_BOUNDS}::DOUBLE[]) AS le UNION ALL SELECT NULL) e WHERE duration IS NOT NULL GROUP BY state, e.le""")
def _(h):
    return metrics.duration_histogram(h.fx_spans)


@check("opt2_duration_quantiles", """
    SELECT state, share, count(*) AS n, true AS within_error
    FROM (SELECT state, unnest([0.5, 0.9, 0.99])::DOUBLE AS share FROM {fx_spans} WHERE duration IS NOT NULL) GROUP BY state, share""")
def _(h):
    """Sketches per day, merged to one per state, held against exact ranks."""
    daily = metrics.duration_sketches(h.fx_spans.withColumn("day", F.to_date("queued_at")), ["state", "day"])
    found = metrics.quantiles(metrics.merge_sketches(daily, ["state"]), ["state"])
    # under and equal: a quantile may stand anywhere among equal values
    ranks = h.fx_spans.filter("duration IS NOT NULL").join(found, "state").groupBy("state", "share", "n").agg(
        F.count_if(F.col("duration") < F.col("quantile")).alias("below"), F.count_if(F.col("duration") <= F.col("quantile")).alias("upto")
    )
    low, high = F.col("below") / F.col("n") - metrics.RANK_ERROR, F.col("upto") / F.col("n") + metrics.RANK_ERROR
    return ranks.select("state", "share", "n", F.col("share").between(low, high).alias("within_error"))


@check("opt2_queue_depth", f"""
    WITH c AS (SELECT queue, queued_at AS moment, 1 AS change FROM {{fx_spans}}
               UNION ALL SELECT queue, ended_at, -1 FROM {{fx_spans}} WHERE ended_at IS NOT NULL),
    m AS (SELECT queue, moment, sum(change) AS change, count(*) FILTER (change > 0) AS opened, count(*) FILTER (change < 0) AS closed
          FROM c GROUP BY queue, moment),
    s AS (SELECT *, CAST(floor(epoch(moment)) AS BIGINT) // {metrics.DEPTH_STEP} AS step,
                 sum(change) OVER (PARTITION BY queue ORDER BY moment) AS level FROM m)
    SELECT queue, make_timestamp(step * {metrics.DEPTH_STEP} * 1000000) AS at, CAST(sum(opened) AS BIGINT) AS opened, CAST(sum(closed) AS BIGINT) AS closed,
           CAST(greatest(max(level), arg_min(level - change, moment)) AS BIGINT) AS peak, CAST(arg_max(level, moment) AS BIGINT) AS depth
    FROM s GROUP BY queue, step""")
def _(h):
    return metrics.queue_depth(h.fx_spans)


@check("ss1_zombie_stream", """
    WITH p AS (SELECT task_key, beat_at, kind, max(beat_at) OVER () AS newest,
                      lead(beat_at) OVER (PARTITION BY task_key ORDER BY beat_at, seq) AS following FROM {fx_heartbeats})
    SELECT CAST(task_key AS VARCHAR) AS task_key, beat_at AS last_beat, beat_at + INTERVAL 12 HOUR AS silent_since FROM p
    WHERE kind <> 'terminal' AND CASE WHEN following IS NULL THEN beat_at + INTERVAL 12 HOUR < newest - INTERVAL 1 MINUTE
                                      ELSE following - beat_at > INTERVAL 12 HOUR END""")
def _(h):
    """Silences of twelve hours as the stream finds them, started anew every eight days."""
    beats = h.fx_heartbeats.selectExpr("CAST(task_key AS STRING) AS task_key", "beat_at", "seq", "kind")
    with replay.state_on_disk(h.spark):
        found = replay.replayed(
            beats, F.expr(_AGE.replace("ts", "beat_at")), LOTS, lambda stream: zombies.stream_zombies(stream, 12 * 3600)
        )
    return found.select("task_key", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_beat", "silent_since")])


@check("ss2_state_stream", """
    SELECT dag_id, run_id, task_id, arg_max(state, (updated_at, seq1, seq2, seq3)) AS state
    FROM {fx_task_events} GROUP BY dag_id, run_id, task_id""")
def _(h):
    """The state table after all events came in three lots of mixed times."""
    table = _folder(h, "states")
    order = ["updated_at", "seq1", "seq2", "seq3"]
    replay.replay(
        h.fx_task_events, F.expr("seq1 % 3"), 3,
        lambda events, checkpoint: tables.stream_current_states(events, table, checkpoint, ["dag_id", "run_id", "task_id"], order, once=True),
    )
    return tables.read_current_states(h.spark, table).select("dag_id", "run_id", "task_id", "state")


@check("ss4_claim_stream", """
    SELECT trigger_id, arg_min(instance_id, (claimed_at, seq)) AS instance_id FROM {fx_claims} GROUP BY trigger_id""")
def _(h):
    """First claims after the claims came in three lots, the earliest of a trigger often last."""
    table = _folder(h, "claims")
    replay.replay(
        h.fx_claims, F.expr("2 - seq % 3"), 3,
        lambda rows, checkpoint: claims.stream_claims(rows, table, checkpoint, ("claimed_at", "seq"), once=True),
    )
    return tables.read_current_states(h.spark, table).select("trigger_id", "instance_id")


@check("ss5_run_stream", """
    SELECT dag_id, logical_date, CAST(min(part_no % 4) AS BIGINT) AS lot, CAST(1 AS BIGINT) AS created
    FROM {fx_candidates} WHERE logical_date IS NOT NULL GROUP BY dag_id, logical_date
    UNION ALL SELECT dag_id, NULL, CAST(part_no % 4 AS BIGINT), count(*) FROM {fx_candidates}
    WHERE logical_date IS NULL GROUP BY dag_id, part_no % 4""")
def _(h):
    """Candidates come in four lots, years early or late; each date has one run, of the first lot that names it."""
    with replay.state_on_disk(h.spark):
        found = replay.replayed(h.fx_candidates, F.expr("part_no % 4"), LOTS, claims.stream_run_dedup)
    lot = F.when(F.col("logical_date").isNull(), F.col("part_no") % 4)
    return found.groupBy("dag_id", "logical_date", lot.alias("__lot")).agg(
        F.min(F.col("part_no") % 4).cast("long").alias("lot"), F.count(F.lit(1)).alias("created")
    ).drop("__lot")
