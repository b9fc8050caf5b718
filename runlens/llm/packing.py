"""Packing of tokenized documents into sequences as a cutting-stock problem, by column generation."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.shared import batch, cut_lineage, release_memory, worker_texts
from runlens.llm.word_cache import word_cache

#: Tokens of a sequence, and the unit in which lengths are binned (rounded up).
SEQUENCE, UNIT = 2048, 16
CAPACITY = SEQUENCE // UNIT
#: The linear program is left when it is proven to be within this share of its optimum; weight of the best prices so far.
GAP, SMOOTH = 5e-4, 0.7

_ITEMS = pa.schema([
    ("part", pa.int32()), ("idx", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()),
    ("length", pa.int32()), ("bin", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary()),
])
_PLACED = pa.schema([
    ("part", pa.int32()), ("idx", pa.int64()), ("length", pa.int32()), ("seq", pa.int64()), ("slot", pa.int32()),
    ("bin", pa.int32()), ("rank", pa.int64()),
])
_CUT = pa.schema([
    ("part", pa.int32()), ("idx", pa.int64()), ("skip", pa.int32()), ("length", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64()),
])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def items(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: whole sequences, then the rest. ids have two bytes each (four for a vocabulary over 65,536).

    `part` and `idx` name a piece; `nth` counts the pieces of its bin in its part.
    They hold for one run of the task, so the result must be written before use.
    """

    def cut(batches):
        part, idx, seen = TaskContext.get().partitionId(), 0, Counter()
        cache = word_cache(tokenizer, spaces=True, lower=False)
        width, end = cache.width, int(end_id).to_bytes(cache.width, "little")
        for b in batches:
            found = cache.encode([t.decode() for t in b.column("text").to_pylist()])
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), found):
                ids += end
                n = len(ids) // width
                for start in range(0, n, SEQUENCE):
                    length = min(SEQUENCE, n - start)
                    kind = -(-length // UNIT)
                    piece = ids[start * width : (start + length) * width]
                    rows.append((part, idx, doc_id, start, n, length, kind, seen[kind], piece))
                    seen[kind] += 1
                    idx += 1
            if rows:
                yield batch(_ITEMS, *map(list, zip(*rows)))
        release_memory()

    return worker_texts(docs, id_col, text_col).mapInArrow(cut, _ddl(_ITEMS))


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity: best value, and how often each size is taken.

    `sizes` ascend.
    """
    useful = np.flatnonzero(values > 1e-12)
    counts = np.zeros(len(sizes), np.int64)
    if not len(useful):
        return 0.0, counts
    v, s = values[useful], sizes[useful]
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), "right").tolist()
    for c in range(int(s[0]), capacity + 1):
        sums = best[c - s[: fits[c]]] + v[: fits[c]]
        k = sums.argmax()
        best[c] = best[c - 1]
        if sums[k] > best[c] + 1e-12:
            best[c], taken[c] = sums[k], k
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[useful[taken[c]]] += 1
            c -= int(s[taken[c]])
    return float(best[capacity]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting: the matrix is small, and the driver's other threads need the cores."""
    m = len(matrix)
    work = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        work -= np.outer(others, work[k])
    return work[:, m:]


def solve(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often to use them: [({size: copies}, times)], together within the demand.

    The linear program "fewest sequences that use up all pieces" is solved by
    column generation: a revised simplex whose columns are priced by the knapsack.
    Times are rounded down, then patterns are used once more, those with the
    largest fractions first, where the remaining pieces allow it.
    """
    sizes = np.array(sorted(k for k, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    proven, anchor = 0.0, None
    for turn in range(40 * m):  # any basis on the way is a feasible packing
        prices = inverse.sum(axis=0)
        times = np.maximum(inverse @ need, 0)
        # prices between the best so far and the present ones swing less; where their pattern does not help, the present ones' does
        for trial in ([] if anchor is None else [SMOOTH * anchor + (1 - SMOOTH) * prices]) + [prices]:
            value, fresh = _best_pattern(trial, sizes, capacity)
            if value > 0 and trial @ need / value > proven:
                proven, anchor = trial @ need / value, trial / value
            if prices @ fresh > 1 + 1e-9:
                break
        if times.sum() <= proven * (1 + GAP) or prices @ fresh <= 1 + 1e-9:
            break
        way = inverse @ fresh
        ratio = np.full(m, np.inf)
        ratio[way > 1e-9] = times[way > 1e-9] / way[way > 1e-9]
        out = int(ratio.argmin())
        columns[:, out] = fresh
        if turn % 40 == 39:
            inverse = _inverse(columns)
        else:
            row = inverse[out] / way[out]
            inverse = inverse - np.outer(way, row)
            inverse[out] = row
    times = np.maximum(_inverse(columns) @ need, 0)
    whole = np.floor(times + 1e-6).astype(np.int64)
    left = need.astype(np.int64) - columns.astype(np.int64) @ whole
    while (left < 0).any():  # rounding noise of the solution
        k = int((whole * (columns[left.argmin()] > 0)).argmax())
        whole[k] -= 1
        left = need.astype(np.int64) - columns.astype(np.int64) @ whole
    for k in np.argsort(-(times - whole), kind="stable"):
        if (columns[:, k] <= left).all():
            whole[k] += 1
            left = left - columns[:, k].astype(np.int64)
    return [
        ({int(s): int(n) for s, n in zip(sizes, columns[:, k]) if n}, int(whole[k])) for k in range(m) if whole[k]
    ]


class Plan:
    """Which sequence and slot the piece of a given bin and rank goes to; ranks beyond the plan are the rest."""

    def __init__(self, demand: dict[int, int]):
        inner = {k: n for k, n in demand.items() if k < CAPACITY}
        patterns = [({CAPACITY: 1}, demand[CAPACITY])] if demand.get(CAPACITY) else []
        self.entries: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter = Counter()
        self.sequences = 0
        for pattern, times in [*patterns, *solve(inner)]:
            slot = 0
            for kind, copies in sorted(pattern.items(), reverse=True):
                self.entries.setdefault(kind, []).append((taken[kind], copies, self.sequences, slot))
                taken[kind] += copies * times
                slot += copies
            self.sequences += times
        self.planned = dict(taken)

    def place(self, kinds: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (-1: the rest) and slot of each piece."""
        seq, slot = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds), np.int32)
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero((kinds == kind) & (ranks < self.planned.get(kind, 0)))
            if not len(own):
                continue
            first, copies, base, at = np.array(self.entries[kind], np.int64).T
            k = np.searchsorted(first, ranks[own], "right") - 1
            past = ranks[own] - first[k]
            seq[own], slot[own] = base[k] + past // copies[k], at[k] + past % copies[k]
        return seq, slot


def _rest_bounds(total: int) -> np.ndarray:
    """Where the stream of remaining pieces is cut: at whole sequences, then at powers of two, so that none needs padding."""
    bounds = list(range(0, total - total % SEQUENCE + 1, SEQUENCE))
    for power in (1 << i for i in range(SEQUENCE.bit_length() - 2, -1, -1)):
        if total % SEQUENCE & power:
            bounds.append(bounds[-1] + power)
    return np.array(bounds, np.int64)


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, ids (binary), length, doc_tokens, sequence_id, offset.

    A document's ids, `end_id` last, are cut into whole sequences and a rest. The
    rests go into sequences as the cutting-stock plan says: pieces of a bin are
    ranked over the whole table, and the plan maps ranks to slots. What the rounded
    plan leaves over, at most some pieces per bin whatever the table's size, is
    laid end to end and cut at sequence ends, finally at powers of two. Sequences
    are padded to SEQUENCE tokens except where they hold a power of two; offsets
    have no gaps. Null and empty texts have `end_id` only; repeated rows and null
    ids are documents of their own; an empty table gives no rows; other columns
    are ignored, whatever their names.

    Only lengths and counts per bin and part are moved to make the plan; the
    driver sees the histogram (CAPACITY numbers). Token ids move once, to their
    places, by a key that no two pieces share.
    """
    pieces = cut_lineage(items(docs, tokenizer, end_id, id_col, text_col))
    counts = cut_lineage(pieces.groupBy("bin", "part").agg(F.count("*").alias("n")))
    demand = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(demand)
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))

    def placed(batches):
        for b in batches:
            kinds, ranks = b.column("bin").to_numpy(), b.column("rank").to_numpy()
            seq, slot = plan.place(kinds, ranks)
            yield batch(
                _PLACED, b.column("part"), b.column("idx"), b.column("length"),
                pa.array(seq, pa.int64(), mask=seq < 0), slot, kinds, ranks,
            )

    ranked = pieces.select("part", "idx", "length", "bin", "nth").join(offsets, ["bin", "part"]).select(
        "part", "idx", "length", "bin", (F.col("base") + F.col("nth")).alias("rank")
    )
    places = cut_lineage(ranked.mapInArrow(placed, _ddl(_PLACED)))

    inside = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    planned = places.filter("seq is not null").select(
        "part", "idx", F.lit(0).alias("skip"), "length", "seq",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
    )
    rest = places.filter("seq is null")
    total = rest.agg(F.sum("length")).first()[0] or 0
    bounds, base = _rest_bounds(int(total)), plan.sequences

    def recut(batches):
        for b in batches:
            rows = []
            for part, idx, length, at in zip(*(b.column(n).to_pylist() for n in ("part", "idx", "length", "at"))):
                k, skip = int(np.searchsorted(bounds, at, "right")) - 1, 0
                while skip < length:
                    take = min(length - skip, int(bounds[k + 1]) - at - skip)
                    rows.append((part, idx, skip, take, base + k, at + skip - int(bounds[k])))
                    skip, k = skip + take, k + 1
            if rows:
                yield batch(_CUT, *map(list, zip(*rows)))

    line = Window.orderBy("bin", "rank").rowsBetween(Window.unboundedPreceding, -1)  # bounded: see above
    laid = rest.select("part", "idx", "length", F.coalesce(F.sum("length").over(line), F.lit(0)).cast("long").alias("at"))
    cuts = cut_lineage(planned.unionByName(laid.mapInArrow(recut, _ddl(_CUT))))

    width = F.octet_length("ids") / F.col("whole")
    return pieces.withColumnRenamed("length", "whole").join(cuts, ["part", "idx"]).select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"),
        F.substring("ids", (F.col("skip") * width + 1).cast("int"), (F.col("length") * width).cast("int")).alias("ids"),
        F.col("length").cast("long").alias("length"), "doc_tokens", F.col("seq").alias("sequence_id"), "offset",
    )
