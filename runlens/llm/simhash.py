"""SimHash near-dedup: fingerprints joined on a grid of their segments' bit counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import components
from runlens.llm.shared import batch, cut_lineage, raw_hash, worker_texts

#: Words of a shingle, differing bits that still link, bits of a segment.
SHINGLE_WORDS, MAX_BITS, SEGMENT_BITS = 3, 2, 4
_SEED = 42
_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
_CELLS = pa.schema([("fp", pa.int64()), ("cell", pa.int64()), ("own", pa.bool_()), ("home", pa.int64())])


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: majority bits of the XXH64 of its word shingles, repeats included.

    A-Z are lower-cased; words are parted by ASCII white space. A text of fewer
    words is one shingle; a text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    of = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        hashes = [of(b" ".join(words), _SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - words_each])).tolist()
        stops = (ends[words_each - 1 :] - 1).tolist()
        hashes = [of(line[i:j], _SEED) for i, j in zip(starts, stops)]
    ones = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 15):  # bounds what a very long text takes
        ones += np.unpackbits(packed[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row per document, null as empty; fp holds the 64 bits as a signed long."""

    def shaped(batches):
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield batch(_FINGERPRINTS, b.column("doc_id"), b.column("text_hash"), found)

    rows = worker_texts(docs, id_col, text_col, raw_hash(text_col).alias("text_hash"))
    return rows.mapInArrow(shaped, "doc_id long, text_hash long, fp long")


def segment_cells(fps: np.ndarray, bits: int = SEGMENT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bit counts of each segment (rows x segments), and each row's counts packed into one number."""
    segments = 64 // bits
    shifts = (np.arange(segments) * bits).astype(np.uint64)
    parts = (fps.view(np.uint64)[:, None] >> shifts) & np.uint64((1 << bits) - 1)
    counts = np.bitwise_count(parts).astype(np.int64)
    return counts, (counts << (3 * np.arange(segments))).sum(axis=1)


def _grid(distinct: DataFrame) -> DataFrame:
    """Each fingerprint at its own grid point and at every point one step away from it."""

    def spread(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            counts, home = segment_cells(fps)
            segments = counts.shape[1]
            steps = np.left_shift(1, 3 * np.arange(segments))
            up, down = counts < SEGMENT_BITS, counts > 0
            cells = np.concatenate([home[:, None], home[:, None] + steps, home[:, None] - steps], axis=1)
            valid = np.concatenate([np.ones((len(fps), 1), bool), up, down], axis=1)
            row, at = np.nonzero(valid)
            yield batch(_CELLS, fps[row], cells[row, at], at == 0, home[row])

    return distinct.mapInArrow(spread, "fp long, cell long, own boolean, home long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints that differ in at most two bits.

    The Hamming distance is at least the Manhattan distance of the segments' bit
    counts. Two points at distance two or less have a grid point within one step
    of both, so a range join with radius two is an equality join of points spread
    by one step each: 33 short rows a fingerprint at most. Of the meeting points
    of a pair those are used that its distance calls for (both at home, one, or
    none), and the exact distance is part of the join's condition, so that only
    true links come out. Both sides are read from a table; the join can be split
    at a crowded grid point.
    """
    grid = cut_lineage(_grid(cut_lineage(fps.select("fp").distinct())))
    a, b = grid.alias("a"), grid.alias("b")
    meets = (
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
        & (
            (F.col("a.own") & F.col("b.own"))
            | ((F.col("a.own") != F.col("b.own")))
            | (~F.col("a.own") & ~F.col("b.own") & (F.col("a.home") != F.col("b.home")))
        )
    )
    return a.join(b, meets).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id (smallest doc_id reachable by links), kept.

    Equal fingerprints count as linked, that of the empty text too. One row of each
    component is kept: that of component_id (of rows that share this id, the one
    with the least hash of its text; repeats of it all say so). Rows without an id
    take part; component_id is null only where a whole component has no id.
    Repeated rows come out as often as they go in. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    lowest = cut_lineage(rows.groupBy("fp").agg(F.min(place).alias("low")))
    roots = cut_lineage(components(links(rows), "a", "b"))
    rooted = lowest.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    best = cut_lineage(rooted.groupBy("root").agg(F.min("low").alias("best")))
    named = cut_lineage(rooted.join(best, "root").select("fp", "best"))
    return rows.join(named, "fp").select(
        "doc_id", "text_hash", "fp", F.col("best.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("kept"),
    )
