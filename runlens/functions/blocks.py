"""Ordered per-key computations that stay distributed when one key is huge.

A plain window puts all rows of a key into one task. Here each key's rows are
cut into blocks along the ordering column: spans of time, or runs of a
sequence number. A block is summarised with a map-side aggregate, the
summaries (one row per key and block) are scanned in block order, and every
row combines the carry of the earlier blocks with a window over (key, block)
only. Results equal the plain window exactly.

Block limits are constants, so a block is the same however often Spark
evaluates it, and no pass over the data is needed to find them. Keys must not
be null; nulls of the ordering column come first, in a block of their own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import cut_lineage

# A block spans a day, or this many values of a sequence number. A unique
# sequence therefore puts at most a million rows into one block.
BLOCK_SECONDS = 86_400
BLOCK_VALUES = 1 << 20


def with_block(df: DataFrame, order_by: str, width: int | None = None) -> DataFrame:
    """Add `__block`, a number that never falls as `order_by` rises."""
    kind = df.schema[order_by].dataType.typeName()
    if kind.startswith("timestamp") or kind == "date":
        position = F.unix_seconds(F.col(order_by).cast("timestamp"))
        width = width or BLOCK_SECONDS
    else:
        position = F.col(order_by)
        width = width or BLOCK_VALUES
    block = F.floor(position / F.lit(width)).cast("long")
    return df.withColumn("__block", F.coalesce(block, F.lit(-(1 << 62))))


def _join_carry(
    blocked: DataFrame, keys: list[str], order: list[str], summary: list[Column],
    carry: Column, inner: list[tuple[str, Column]],
) -> DataFrame:
    """Every row with what its key's earlier blocks hand on; null where there is none.

    Most keys have one block, which gets nothing: only blocks with a carry go to the join.
    """
    in_block = [*keys, "__block"]
    carries = (
        blocked.groupBy(*in_block).agg(*summary)
        .withColumn("__carry", carry)
        .filter(F.col("__carry").isNotNull())
        .select(*in_block, "__carry")
    )
    rows = blocked
    for name, expression in inner:
        rows = rows.withColumn(name, expression)
    return rows.join(carries, in_block, "left")


def _within(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "__block").orderBy(*order)


def _across(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("__block")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add the 1-based position of each row among its key's rows."""
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_carry(
        with_block(df, order[0]), keys, order,
        [F.count(F.lit(1)).alias("__n")],
        F.sum("__n").over(before),
        [("__rn", F.row_number().over(_within(keys, order)))],
    )
    return joined.withColumn(
        out, (F.col("__rn") + F.coalesce("__carry", F.lit(0))).cast("long")
    ).drop("__rn", "__carry", "__block")


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """`numbered` for an order whose first column takes few values, or values far from even.

    Rows are sorted over all tasks by key and order and written once; a key that spans
    several tasks gets each part's number of rows before it added.
    """
    sorted_ = df.repartitionByRange(*keys, *order) if keys or order else df
    held = cut_lineage(sorted_.withColumn("__part", F.spark_partition_id()))
    parts = held.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per key and task
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return held.withColumn(out, place).join(offsets, [*keys, "__part"]).withColumn(
        out, (F.col(out) + F.col("__before")).cast("long")
    ).drop("__part", "__before")


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], take: dict[str, str],
    following: bool = False,
) -> DataFrame:
    """Add columns of the previous (or following) row of the same key.

    `take` maps the new column's name to the column to fetch.
    """
    values = F.struct(*[F.col(source).alias(out) for out, source in take.items()])
    rank = F.struct(*order)
    if following:
        edge = F.min_by(values, rank)
        carry = F.lead("__edge").over(_across(keys))
        inner = F.lead(values).over(_within(keys, order))
    else:
        edge = F.max_by(values, rank)
        carry = F.lag("__edge").over(_across(keys))
        inner = F.lag(values).over(_within(keys, order))
    joined = _join_carry(
        with_block(df, order[0]), keys, order, [edge.alias("__edge")], carry,
        [("__near", inner)],
    )
    near = F.coalesce("__near", "__carry")
    return joined.select(*df.columns, *[near[out].alias(out) for out in take])


def with_first(
    df: DataFrame, keys: list[str], order: list[str], take: dict[str, str], salts: int = 256
) -> DataFrame:
    """Add columns of the key's first row in `order` to all rows of the key.

    `take` maps the new column's name to the column to fetch. Blocks are
    salts of the order columns here, since rivals for one key tend to be close
    in time: the firsts of a key's salts are compared, and each salt's rows
    are joined to the winner on (key, salt). Rows are dealt by (key, salt)
    before the firsts are taken, since most salts hold one row, and a first
    holds each column once.
    """
    salt = F.coalesce(F.pmod(F.xxhash64(*order), F.lit(salts)), F.lit(0))
    in_block = [*keys, "__block"]
    salted = df.withColumn("__block", salt).repartition(*in_block)
    candidate = F.struct(*order, *[source for source in dict.fromkeys(take.values()) if source not in order])
    firsts = (
        salted.groupBy(*in_block).agg(F.min(candidate).alias("__first"))
        .withColumn("__first", F.min("__first").over(Window.partitionBy(*keys)))
    )
    joined = salted.join(firsts, in_block)
    return joined.select(*df.columns, *[F.col("__first")[source].alias(out) for out, source in take.items()])


def running_sum_before(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Add the sum of `value` over all earlier rows of the same key (0 for the first)."""
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    earlier = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_carry(
        with_block(df, order[0]), keys, order,
        [F.sum(value).alias("__sum")],
        F.sum("__sum").over(before),
        [("__near", F.coalesce(F.sum(value).over(earlier), F.lit(0)))],
    )
    total = F.col("__near") + F.coalesce("__carry", F.lit(0))
    return joined.withColumn(out, total).drop("__near", "__carry", "__block")


def running_max_before(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Add the maximum of `value` over all earlier rows of the same key."""
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    earlier = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_carry(
        with_block(df, order[0]), keys, order,
        [F.max(value).alias("__max")],
        F.max("__max").over(before),
        [("__near", F.max(value).over(earlier))],
    )
    return joined.withColumn(out, F.greatest("__near", "__carry")).drop(
        "__near", "__carry", "__block"
    )
