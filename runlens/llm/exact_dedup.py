"""Exact dedup against a historical corpus that is held as minimal perfect hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.shared import batch, cut_lineage, mix, raw_hash, worker_texts

#: Distinct digests that one shard of the index holds on average, and the fewest shards.
SHARD_DIGESTS, LEAST_SHARDS = 20_000, 1024

_DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("uid", pa.int64()), ("old", pa.bool_()), ("digest", pa.binary())
])


def digests(docs: DataFrame, is_history=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, uid, old, digest): SHA-256 of every text, A-Z lower-cased, null as empty."""

    def hashed(batches):
        for b in batches:
            found = [hashlib.sha256(t.lower()).digest() for t in b.column("text").to_pylist()]
            yield batch(_DIGESTS, *(b.column(name) for name in _DIGESTS.names[:-1]), found)

    old = F.lit(False) if is_history is None else F.coalesce(is_history, F.lit(False))
    rows = worker_texts(
        docs, id_col, text_col,
        raw_hash(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("uid"), old.alias("old"),
    )
    return rows.mapInArrow(hashed, "doc_id long, text_hash long, uid long, old boolean, digest binary")


def winners(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the row that stays (largest id, nulls least, then first uid) and the group's size."""
    best = F.max(F.struct("doc_id", (-F.col("uid")).alias("at"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count("*").alias("n")).select(
        "digest", F.col("best.doc_id").alias("doc_id"), (-F.col("best.at")).alias("uid"), "n"
    )


class PerfectHash:
    """A minimal perfect hash of 32-byte digests: levels of bit arrays, a slot is the rank of the key's bit.

    At each level a key without a rival for its cell gets the cell's bit; the
    others go to the next level, whose cells depend on another word of the digest.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        starts = np.cumsum([0, *(int(level.sum()) for level in levels)])
        self.ranks = [np.cumsum(level) - 1 + start for level, start in zip(levels, starts)]

    @staticmethod
    def _cells(words: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mix(words[:, level % 4] ^ mix(words[:, (level + 1) % 4] + salt)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, left = [], words
        while len(left):
            cells = cls._cells(left, len(levels), size := 2 * len(left) + 1)
            alone = np.bincount(cells, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[cells]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of every key; a key that was not built in gets any slot, or -1."""
        found = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for k, level in enumerate(self.levels):
            cells = self._cells(words[open_], k, len(level))
            hit = level[cells]
            found[open_[hit]] = self.ranks[k][cells[hit]]
            open_ = open_[~hit]
        return found

    def dump(self) -> bytes:
        sizes = np.array([len(x) for x in self.levels], "<i8")
        return np.int64(len(sizes)).tobytes() + sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", count, 8), 8 + 8 * count, []
        for size in sizes.tolist():
            bits = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(bits, count=size).astype(bool))
            at += len(bits)
        return cls(levels)


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(bytearray(b"".join(digests.to_pylist())), "<u8").reshape(-1, 4)


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """The index of a historical corpus's rows (as `digests` gives them), and its number of shards.

    One row per shard: the perfect hash of its distinct digests, and by slot the
    full digest, the locator (id and uid) of the row that stays and the group's
    size. Digests are aggregated before they move, so a text that repeats any
    number of times is one row here; shards are filled by hash.
    """
    distinct = cut_lineage(winners(history))
    if shards is None:
        shards = max(LEAST_SHARDS, -(-distinct.count() // SHARD_DIGESTS))

    def built(part):
        words = _words(part.column("digest"))
        hashed = PerfectHash.build(words)
        order = np.argsort(hashed.slots(words))
        fields = [words, *_row_arrays(part)]
        return pa.table({
            "shard": pa.array([part.column("shard")[0].as_py()], pa.int32()),
            "hash": pa.array([hashed.dump()], pa.binary()),
            **{name: pa.array([field[order].tobytes()], pa.binary()) for name, field in zip(_FIELDS, fields)},
        })

    schema = "shard int, hash binary, " + ", ".join(f"{name} binary" for name in _FIELDS)
    return cut_lineage(_sharded(distinct, shards).groupBy("shard").applyInArrow(built, schema)), shards


#: What a slot holds, each as one array over the slots of a shard.
_FIELDS = ("digests", "ids", "named", "uids", "sizes")


def _row_arrays(part: pa.Table) -> tuple[np.ndarray, ...]:
    """Ids (0 for null), whether there is an id, uids, sizes."""
    ids = part.column("doc_id")
    return (
        ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), part.column("uid").to_numpy(), part.column("n").to_numpy()
    )


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Final (digest, keep_id, keep_uid, group_size, known) over history and the new rows.

    `known`: the digest was in the history. New digests are aggregated first.
    Members are recognized by comparing the full digest with the one in their
    slot; the others form groups of their own.
    """

    def found(words, ids, named, uids, sizes, known):
        return pa.table({
            "digest": pa.array([x.tobytes() for x in words], pa.binary()),
            "keep_id": pa.array(ids, pa.int64(), mask=~named),
            "keep_uid": pa.array(uids, pa.int64()), "group_size": pa.array(sizes, pa.int64()),
            "known": pa.array(np.full(len(words), known)),
        })

    def probed(fresh, held):
        words = _words(fresh.column("digest"))
        new_ids, new_named, new_uids, new_sizes = _row_arrays(fresh)
        if not held.num_rows:
            return found(words, new_ids, new_named, new_uids, new_sizes, False)
        kinds = ("<u8", "<i8", bool, "<i8", "<i8")
        full, ids, named, uids, sizes = (
            np.frombuffer(held.column(name)[0].as_py(), kind).copy() for name, kind in zip(_FIELDS, kinds)
        )
        full = full.reshape(-1, 4)
        slot = PerfectHash.load(held.column("hash")[0].as_py()).slots(words)
        member = slot >= 0
        member[member] = (full[slot[member]] == words[member]).all(axis=1)
        at = slot[member]
        sizes[at] += new_sizes[member]
        has, i, u = new_named[member], new_ids[member], new_uids[member]
        same = (has == named[at]) & ((i == ids[at]) | ~has)
        better = (has & (~named[at] | (i > ids[at]))) | (same & (u < uids[at]))
        ids[at[better]], named[at[better]], uids[at[better]] = i[better], has[better], u[better]
        own = ~member
        return pa.concat_tables([
            found(full, ids, named, uids, sizes, True),
            found(words[own], new_ids[own], new_named[own], new_uids[own], new_sizes[own], False),
        ])

    fresh = _sharded(winners(new), shards)
    return fresh.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(
        probed, "digest binary, keep_id long, keep_uid long, group_size long, known boolean"
    )


def dedup(docs: DataFrame, is_history, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One decision per row of `docs`: doc_id, text_hash, keep_id, group_size, kept, text_sha256, known.

    `is_history` is a condition over `docs` that parts the historical corpus from
    the new delivery (null counts as new). Texts are equal when identical after
    lower-casing A-Z; null is the empty text. Of equal texts the row with the
    largest id stays (a null id is less than any, so keep_id is null only if all
    ids are); of rows that share that id the first one stays. An empty table gives
    no rows. Other columns are ignored, whatever their names.

    Texts are read once, where they lie. Groups are aggregated before every
    shuffle; the verdicts are written as a table, so that the join that brings
    them to the rows can be split at a text that a third of all rows share.
    """
    rows = cut_lineage(digests(docs, is_history, id_col, text_col))
    index, shards = build_index(rows.filter("old"))
    verdicts = cut_lineage(look_up(rows.filter("not old"), index, shards))
    return rows.join(verdicts, "digest").select(
        "doc_id", "text_hash", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "known",
    )
