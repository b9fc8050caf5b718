"""Column expressions over run ids, states and attempts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.values import RUN_TRIGGERS, TERMINAL_STATES


def is_terminal(state: Column) -> Column:
    return F.coalesce(state.isin(*TERMINAL_STATES), F.lit(False))


def run_trigger(run_id: Column) -> Column:
    head = F.substring_index(run_id, "-", 1)
    return F.when(head.isin(*RUN_TRIGGERS), head).otherwise("unknown")


def make_run_id(trigger: Column, dag_id: Column, logical_date: Column) -> Column:
    """The id a scheduled, recovered or backfill run gets for its logical date."""
    prefix = F.when(trigger == "recovered", "scheduled").otherwise(trigger)
    stamp = F.date_format(logical_date, "yyyyMMdd'T'HHmmss")
    return F.concat(prefix, F.lit("-"), dag_id, F.lit("-"), stamp)


def make_manual_run_id(dag_id: Column, seed: Column, digits: int = 24) -> Column:
    """A manual run's id: `digits` hex digits after the DAG.

    24 of them hold 96 bits, so that ids of one DAG do not meet. They come from a digest of the request, not from a random source, so a
    recomputed task gives the same id again.
    """
    digest = F.sha2(F.concat_ws("|", dag_id, seed.cast("string")), 256)
    return F.concat(F.lit("manual-"), dag_id, F.lit("-"), F.substring(digest, 1, digits))


def has_retries_left(attempts_made: Column, retries: Column) -> Column:
    return attempts_made <= retries


def next_retry_delay(
    attempts_made: Column, retry_delay: Column, exponential: Column
) -> Column:
    base = retry_delay.cast("double")
    return F.when(
        exponential, base * F.pow(F.lit(2.0), (attempts_made - 1).cast("double"))
    ).otherwise(base)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def settled_state(last_state: Column, attempts_made: Column, retries: Column) -> Column:
    """The task state that follows from the last attempt."""
    return (
        F.when(last_state == "success", "success")
        .when(last_state == "skipped", "skipped")
        .when(has_retries_left(attempts_made, retries), "up_for_retry")
        .otherwise("failed")
    )


def parse_timestamp(text: Column) -> Column:
    """Both spellings (`T` or a space); text that is no timestamp gives null."""
    return text.try_cast("timestamp_ntz")
