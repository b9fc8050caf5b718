"""Embedding near-dedup by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import components
from runlens.llm.shared import batch, cut_lineage, mix

#: Cosine that links, width of a quantised projection, recall aimed at for pairs that lie exactly at the limit.
MIN_COSINE, WIDTH, RECALL = 0.9, 2.0, 0.95
#: Unlinked vectors that may share a bucket with a vector, on average.
STRAYS = 8.0
#: Vectors of one block of a bucket, and pairs compared at once.
BLOCK, PAIRS = 256, 400_000

_KEYS = pa.schema([("tab", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("vec", pa.list_(pa.float64()))])
_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def collide(distance: float) -> float:
    """Chance that one quantised projection of two points at this distance is the same (2-stable law)."""
    t = WIDTH / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Tables:
    """`projections` numbers make a key; `tables` keys make the chance of a pair at the limit to share one RECALL."""

    projections: int
    tables: int
    seed: int = 42

    @classmethod
    def for_rows(cls, rows: int) -> Tables:
        """More projections as the table grows, so that strays per vector stay the same, and the tables that takes."""
        near, far = collide(math.sqrt(2 - 2 * MIN_COSINE)), collide(math.sqrt(2))
        k = max(4, math.ceil(math.log(max(rows, 2) / STRAYS) / -math.log(far)))
        return cls(k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Keys of normalised vectors: rows x tables."""
        rng = np.random.default_rng(self.seed)
        lines = rng.normal(size=(unit.shape[1], self.tables * self.projections))
        shifts = rng.uniform(0, WIDTH, self.tables * self.projections)
        cells = np.floor((unit @ lines + shifts) / WIDTH).astype(np.int64).astype(np.uint64)
        cells = cells.reshape(len(unit), self.tables, self.projections)
        out = np.full((len(unit), self.tables), unit.shape[1], np.uint64)
        for i in range(self.projections):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return out.view(np.int64)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    return F.coalesce(
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _unit(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _hashed(distinct: DataFrame, tables: Tables) -> DataFrame:
    """Every vector once per table: (tab, key, id, copies, vec)."""

    def spread(batches):
        for b in batches:
            lengths = b.column("vec").value_lengths().to_numpy()
            for dim in np.unique(lengths):
                some = b.filter(pa.array(lengths == dim))
                for at in range(0, some.num_rows, 512):
                    part = some.slice(at, 512)
                    keys = tables.keys(_unit(part.column("vec")))
                    n, t = keys.shape
                    index = pa.array(np.repeat(np.arange(n), t))
                    yield batch(
                        _KEYS, np.tile(np.arange(t, dtype=np.int32), n), keys.ravel(),
                        part.column("id").take(index), part.column("copies").take(index),
                        part.column("vec").take(index).cast(pa.list_(pa.float64())),
                    )

    return distinct.mapInArrow(spread, "tab int, key long, id long, copies long, vec array<double>")


def _compared(groups: DataFrame, tables: Tables) -> DataFrame:
    """(id, links, other) from rows sorted by their group: linked partners that a vector meets here first.

    `other` is the smallest vector that a chain of such links leads to. A pair
    counts only in the first table whose keys it shares.
    """

    def compared(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g").to_numpy()
            last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            yield from matched(table.slice(0, last))
            held = table.slice(last).to_batches()  # the last group may go on
        if held:
            yield from matched(pa.Table.from_batches(held).combine_chunks())

    def matched(table):
        g = table.column("g").to_numpy()
        if len(g) < 2:
            return
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sizes = np.diff(np.append(starts, len(g)))
        wide = sizes > 1
        starts, sizes = starts[wide], sizes[wide]
        # of whole groups as many at a time as make a bounded number of pairs
        cost = np.cumsum(sizes * (sizes - 1) // 2)
        at = 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
            rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[at:upto], sizes[at:upto])])
            yield from linked(table.take(pa.array(rows)), sizes[at:upto])
            at = upto

    def linked(table, sizes):
        unit = _unit(table.column("vec").combine_chunks())
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        side, tab = table.column("side").to_numpy(), table.column("tab").to_numpy()
        left, right, at = [], [], 0
        for n in sizes:
            i, j = np.triu_indices(n, 1)
            left.append(i + at)
            right.append(j + at)
            at += n
        i, j = np.concatenate(left), np.concatenate(right)
        met = side[i] != side[j]
        met |= (side[i] == 2)  # 2: a block with itself; 0 and 1: one block with another
        i, j = i[met], j[met]
        near = np.concatenate([
            np.einsum("ij,ij->i", unit[i[k : k + 50_000]], unit[j[k : k + 50_000]]) >= MIN_COSINE
            for k in range(0, len(i), 50_000)
        ]) if len(i) else np.zeros(0, bool)
        i, j = i[near], j[near]
        if not len(i):
            return
        used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = tables.keys(unit[used])
        a, b = where[: len(i)], where[len(i) :]
        first = np.concatenate([
            (keys[a[k : k + 50_000]] == keys[b[k : k + 50_000]]).argmax(axis=1) for k in range(0, len(i), 50_000)
        ]) == tab[i]
        i, j, a, b = i[first], j[first], a[first], b[first]
        if not len(i):
            return
        links = np.bincount(a, weights=copies[j], minlength=len(used)) + np.bincount(b, weights=copies[i], minlength=len(used))
        low = ids[used].copy()
        while True:  # the smallest id spreads over the links
            best = low.copy()
            np.minimum.at(best, a, low[b])
            np.minimum.at(best, b, low[a])
            if (best == low).all():
                break
            low = best
        some = links > 0
        yield batch(_FOUND, ids[used][some], links[some].astype(np.int64), low[some])

    return groups.mapInArrow(compared, "id long, links long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of MIN_COSINE or more, in double precision, if they
    share a bucket in some table: recall is RECALL for pairs exactly at the limit
    and higher above it; what is linked is never below the limit. Vectors that are
    null, empty, zero or hold null or non-finite numbers link with nothing, nor do
    vectors of different lengths. Rows with equal vectors are linked with each
    other (repeated rows too). component_id is the smallest id reachable; a row
    without an id is counted as a link, and its component is named by the others
    (null if none has an id). An empty table gives no rows; other columns are
    ignored, whatever their names.

    Equal vectors are one vector with a number of copies. A bucket is cut into
    blocks that are compared two by two, so a crowded one is spread over tasks;
    each comparison hands on a count and one link per vector, not its pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    rows = rows.withColumn("ok", usable(F.col("vec"))).withColumn("vec", F.when(F.col("ok"), F.col("vec")))
    rows = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))
    # vectors are told apart by all their numbers; uid is the first of the rows that hold one
    distinct = cut_lineage(rows.filter("ok").groupBy("vec").agg(
        F.min("uid").alias("id"), F.count("*").alias("copies"), F.min("vec_id").alias("low")
    ))
    tables = Tables.for_rows(distinct.count())
    hashed = cut_lineage(_hashed(distinct.select("id", "copies", "vec"), tables))
    crowd = cut_lineage(hashed.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # block i meets block j in the group of the two; side 2 where a block meets itself
    placed = hashed.join(crowd, ["tab", "key"]).withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    ).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "peer"), F.greatest("own", "peer")
    groups = placed.select(
        F.xxhash64("tab", "key", low, high).alias("g"), "tab",
        F.when(F.col("own") == F.col("peer"), 2).when(F.col("own") < F.col("peer"), 0).otherwise(1).cast("int").alias("side"),
        "id", "copies", "vec",
    )
    found = cut_lineage(_compared(groups.repartition("g").sortWithinPartitions("g"), tables))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found, "id", "other")
    named = distinct.select("id", "copies", "low").join(counts, "id", "left").join(
        roots.withColumnRenamed("node", "id"), "id", "left"
    ).select("id", "copies", "low", "links", F.coalesce("root", "id").alias("root"))
    named = cut_lineage(named)
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    verdicts = cut_lineage(named.join(least, "root").join(distinct.select("id", "vec"), "id").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    ))
    judged = rows.filter("ok").join(verdicts, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
