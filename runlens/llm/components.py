"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import cut_lineage


def _lowest(links: DataFrame) -> DataFrame:
    """(u, low): the smallest end that u is linked with, or itself."""
    return links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked with u's smallest neighbour."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut_lineage(_lowest(both))
    return (
        both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, is linked with the smallest of them."""
    low = cut_lineage(_lowest(links))
    moved = links.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.withColumnRenamed("low", "v")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    Alternating large-star and small-star steps: each is one aggregate and one
    join over the links, whose number never grows, and some log(n) steps are
    enough. Smallest neighbours are aggregates with a map-side part and are
    written as tables, so the joins with them may be split at a hot node.
    Self-links and repeats are allowed; nulls are not linked. Empty input gives
    no rows.
    """
    links = cut_lineage(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        links = cut_lineage(_small_star(cut_lineage(_large_star(links))))
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
