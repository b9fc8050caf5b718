"""First-wins deduplication on streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.streaming.tables import stream_winners


def first_claims(claims: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The whole row of the first claim per key; ties go by the other columns."""
    held = [name for name in claims.columns if name not in keys]
    ranked = [*order, *[name for name in held if name not in order]]
    return claims.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("__row")).select(
        *keys, *[f"__row.{name}" for name in held]
    )


def stream_claims(
    claims: DataFrame, table: str, checkpoint: str, order: tuple[str, ...] = ("claimed_at",),
    buckets: int = 32, once: bool = False,
) -> StreamingQuery:
    """Keep the first claim per trigger in a table, by the time of the claim, not of its arrival.

    A claim may come as late as it likes: it is compared with the one that the
    table holds. Read the table with `tables.read_current_states`.
    """
    return stream_winners(
        claims, table, checkpoint, ["trigger_id"],
        lambda rows, keys: first_claims(rows, keys, order), buckets, once,
    )


def stream_run_dedup(candidates: DataFrame) -> DataFrame:
    """First scheduled run per (dag_id, logical date to the second); runs without a logical date all stay.

    The first to arrive wins, and for ever: the keys of all runs created stay in the
    state store, outside any watermark, so a rival that comes days later is still
    refused, and a run that comes late for a date of its own is still created. A
    batch touches its own keys only. Rivals in one batch: one of them wins. Use the
    RocksDB state store; runs without a date are passed by and take no state.
    """
    dated = F.col("logical_date").isNotNull()
    second = F.date_trunc("second", "logical_date")
    first = candidates.filter(dated).withColumn("__second", second).dropDuplicates(["dag_id", "__second"]).drop("__second")
    return first.unionByName(candidates.filter(~dated))
