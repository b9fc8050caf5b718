"""A join for the case adaptive skew splitting cannot see.

Spark splits a hot key at run time only where both sides come straight from a
shuffle. A side that was just aggregated by the join key keeps its place and
blocks the split. `spread_join` spreads the big side by a salt instead and
gives each salt its copy of the small side.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIES = 32


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
    copies: int = COPIES, few: bool = False,
) -> DataFrame:
    """Equi-join in which every key of `big` meets up to `copies` tasks.

    For sides that grow with the catalog, not with the history: `small` is
    copied. The salt comes from the row and the partition it was read in, so a
    repeated task gives the same salts, and equal rows of different partitions
    part too. Any salt finds its copy, so the result is that of a plain join.

    The copies are never broadcast: Spark judges `small` by the compressed file it
    was read from, without the copies, and the driver would have to hold them all.
    With `few`, for sides of few rows whatever the size of the history, Spark decides.
    """
    plain = [
        F.col(field.name) for field in big.schema.fields
        if field.dataType.typeName() not in ("map", "variant")
    ]
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(copies)).cast("int")
    spread = big.withColumn("__salt", salt)
    copied = small.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )
    return spread.join(copied if few else unbroadcast(copied), [*keys, "__salt"], how).drop("__salt")


def unbroadcast(df: DataFrame) -> DataFrame:
    """A join's side that grows with the catalog: it is shuffled and sorted, whatever its file's size suggests.

    A broadcast that Spark plans from the size of a compressed file stays, even where
    the rows turn out to fill the driver's memory.
    """
    return df.hint("merge")
