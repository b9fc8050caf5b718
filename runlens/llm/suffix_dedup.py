"""Removal of long repeated byte strings by sparse suffix sorting (deep-shallow)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.chunks import Dictionaries, parts, placed, write_dictionary
from runlens.llm.shared import batch, cut_lineage, mix, raw_hash, worker_texts

#: Bytes of a string whose repeats are removed unless another length is asked for, and of an anchor in it (the least length).
LENGTH, ANCHOR = 400, 64
#: Bytes that the multikey quicksort looks at before blind tries take over.
SHALLOW = 32
#: Different surroundings of one anchor that are sorted in one place; those of commoner anchors are told apart by halving.
CROWD = 512

_BLOCK = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(1, 7, dtype=np.uint64)) | np.uint64(1)

_ANCHORS = pa.schema([
    ("chunk", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("anchor", pa.int64()), ("around", pa.int64()),
    ("lo", pa.int64()), ("span", pa.int32()), ("at", pa.int32()),
])
_CONTEXTS = pa.schema([
    ("anchor", pa.int64()), ("around", pa.int64()), ("twice", pa.bool_()), ("crowded", pa.bool_()), ("chunk", pa.int64()),
    ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("span", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary()),
])
_SPANS = pa.schema([("chunk", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())])
_RANGES = pa.schema([
    ("anchor", pa.int64()), ("twice", pa.bool_()), ("chunk", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
    ("lo", pa.int64()), ("span", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary()), ("j", pa.int32()),
    ("whole", pa.bool_()), ("u1", pa.int64()), ("u2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()),
])
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()),
])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def anchors(data: bytes, length: int = LENGTH):
    """(anchor hash, first window, windows - 1, anchor's place in the first window) of all strings of `length` bytes.

    The anchor of a window is the ANCHOR bytes in it with the smallest hash, the
    leftmost of equals: it depends on the window's bytes alone, so equal windows
    have equal anchors at equal places. Windows next to each other that share an
    anchor come as one row.
    """
    for begin in range(0, len(data) - length + 1, _BLOCK):
        block = np.frombuffer(data, np.uint8)[begin : begin + _BLOCK + length - 1]
        code, step = _BYTE_CODES[block], 1
        for factor in _FACTORS:  # 1, 2, 4, ... 64 bytes
            code = code[:-step] * factor + code[step:]
            step *= 2
        code = mix(code)
        low = (code & ~_POSITION) | np.arange(len(code), dtype=np.uint64)
        wide, step = length - ANCHOR + 1, 1
        while 2 * step <= wide:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (wide - step)], low[wide - step :])
        place = (low & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        yield from zip(code[p].view(np.int64).tolist(), (first + begin).tolist(), (last - first).tolist(), (p - first).tolist())


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """One row per run of windows with one anchor; `around` is the hash of all the bytes of these windows.

    Every chunk also has rows with nothing but its name.
    """

    def found(batches):
        for b in batches:
            out = [(chunk, *[None] * 7) for chunk in b.column("chunk").unique().to_pylist()]
            for chunk, k1, k2, data in zip(*(b.column(n).to_pylist() for n in ("chunk", "more_0", "more_1", "text"))):
                for code, lo, span, at in anchors(data, length):
                    around = xxhash.xxh64_intdigest(data[lo : lo + span + length], at) - (1 << 63)
                    out.append((chunk, k1, k2, code, around, lo, span, at))
                if len(out) > 20_000:
                    yield batch(_ANCHORS, *map(list, zip(*out)))
                    out = []
            if out:
                yield batch(_ANCHORS, *map(list, zip(*out)))

    return rows.mapInArrow(found, _ddl(_ANCHORS))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], which: list[int]) -> tuple[list[int], list[int]]:
    """Sorted order of strings that share a long prefix, and the common prefixes of neighbours.

    The trie keeps only where strings branch and the first byte of each branch. A
    string goes down it blindly, is compared once with a string found below, and
    is put in where the two part.
    """
    # a node is [depth, {byte: node}], a leaf an index; -1 stands for the end of a string
    root = which[0]

    def byte(i: int, depth: int) -> int:
        return strings[i][depth] if depth < len(strings[i]) else -1

    equal: dict[int, list[int]] = {}
    for i in which[1:]:
        node = root
        while not isinstance(node, int):
            below = node[1]
            b = byte(i, node[0])
            node = below[b] if b in below else next(iter(below.values()))
        seen = node
        depth = common(strings[seen], strings[i])
        if depth == len(strings[i]) == len(strings[seen]):
            equal.setdefault(seen, []).append(i)
            continue
        above, node = None, root
        while not isinstance(node, int) and node[0] < depth:
            above, node = node, node[1][byte(i, node[0])]
        if not isinstance(node, int) and node[0] == depth:
            node[1][byte(i, depth)] = i
            continue
        fresh = [depth, {byte(seen, depth): node, byte(i, depth): i}]
        if above is None:
            root = fresh
        else:
            above[1][byte(i, above[0])] = fresh
    order, shared = [], []
    stack = [(root, 0)]
    while stack:
        node, with_last = stack.pop()
        if isinstance(node, int):
            for k, i in enumerate([node, *equal.get(node, ())]):
                shared.append(with_last if k == 0 else len(strings[i]))
                order.append(i)
            continue
        below = [child for _, child in sorted(node[1].items())]
        for k in range(len(below) - 1, -1, -1):
            stack.append((below[k], node[0] if k else with_last))
    return order, shared[1:]


def sort_strings(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Deep-shallow sort: the order, and the common prefix of each string with the next.

    Multikey quicksort on eight bytes at a time down to SHALLOW bytes; what is
    still together there is ordered by a blind trie.
    """
    words = np.zeros((len(strings), SHALLOW // 8), ">u8")
    heads = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    words[:] = np.frombuffer(heads, ">u8").reshape(len(strings), -1)
    keys = words.astype(np.uint64)
    order: list[int] = []
    shared: list[int] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:
        which, depth = stack.pop()
        if not len(which):
            continue
        if len(which) == 1:
            found, inner = [int(which[0])], []
        elif depth == keys.shape[1]:
            found, inner = blind_trie(strings, which.tolist())
        else:
            column = keys[which, depth]
            pivot = np.sort(column)[len(column) // 2]
            for part, deeper in ((column > pivot, 0), (column == pivot, 1), (column < pivot, 0)):
                stack.append((which[part], depth + deeper))
            continue
        if order:
            shared.append(common(strings[order[-1]], strings[found[0]]))
        order += found
        shared += inner
    return order, shared


def repeated(contexts: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For bytes around one anchor, (bytes, anchor's place, windows - 1) each: ranges of windows that another one has too.

    Two windows are equal if what precedes the anchor and what follows it agree far
    enough. Both sides are sorted; common lengths of any two are least neighbours.
    """
    m = len(contexts)
    sides = []
    for strings in ([c[at:] for c, at, _ in contexts], [c[:at][::-1] for c, at, _ in contexts]):
        order, shared = sort_strings(strings)
        table = np.full((m, m), -1, np.int32)
        for i in range(m - 1):
            least = np.minimum.accumulate(shared[i:])
            table[order[i], order[i + 1 :]] = least
            table[order[i + 1 :], order[i]] = least
        sides.append(table)
    right, left = sides
    out = []
    for i, (_, at, span) in enumerate(contexts):
        begin = np.maximum(at - left[i], 0)
        stop = np.minimum(at - length + right[i], span)
        good = (left[i] >= 0) & (begin <= stop)
        out.append(merge(sorted(zip(begin[good].tolist(), (stop[good] + 1).tolist()))))
    return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted half-open ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for begin, stop in ranges:
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((begin, stop))
    return out


def _by_row(table: pa.Table, names: tuple[str, ...]) -> dict:
    rows: dict = {}
    for k1, k2, *rest in zip(*(table.column(n).to_pylist() for n in ("k1", "k2", *names))):
        if k1 is not None:  # else a row that only says that the chunk is there
            rows.setdefault((k1, k2), []).append(tuple(rest))
    return rows


def _contexts(rows: DataFrame, contested: DataFrame, chunks: DataFrame, length: int) -> DataFrame:
    """The bytes of contested windows, read where the texts lie."""
    names = ("anchor", "around", "twice", "crowded", "lo", "span", "at")
    folder = write_dictionary(contested.unionByName(chunks, allowMissingColumns=True), "suffix-contexts")

    def read(batches):
        dictionaries = Dictionaries(folder, lambda t: _by_row(t, names))
        for b in batches:
            for chunk, part in parts(b):
                wanted, out = dictionaries[chunk], []
                for k1, k2, data in zip(*(part.column(n).to_pylist() for n in ("more_0", "more_1", "text"))):
                    for anchor, around, twice, crowded, lo, span, at in wanted.get((k1, k2), ()):
                        out.append((anchor, around, twice, crowded, chunk, k1, k2, lo, span, at, data[lo : lo + span + length]))
                    if len(out) > 5000:
                        yield batch(_CONTEXTS, *map(list, zip(*out)))
                        out = []
                if out:
                    yield batch(_CONTEXTS, *map(list, zip(*out)))

    return rows.mapInArrow(read, _ddl(_CONTEXTS)).dropDuplicates(["anchor", "around"])


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans to remove, from contexts of anchors that are not crowded."""

    def compared(batches):
        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(n).to_pylist() for n in _CONTEXTS.names)):
                if held and held[0][0] != row[0]:
                    out += judged(held)
                    held = []
                held.append(row)
            if out:
                yield batch(_SPANS, *map(list, zip(*out)))
        if held and (out := judged(held)):
            yield batch(_SPANS, *map(list, zip(*out)))

    def judged(group):
        if len(group) < 2:
            return []
        ranges = repeated([(r[10], r[9], r[8]) for r in group], length)
        return [
            (chunk, k1, k2, lo + begin, lo + stop - 1 + length)
            for (_, _, twice, _, chunk, k1, k2, lo, *_), found in zip(group, ranges) if not twice for begin, stop in found
        ]

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compared, _ddl(_SPANS))


def _crowd_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans to remove, from contexts of crowded anchors, by halving ranges of windows.

    A range holds the windows that begin j to j + size - 1 bytes before the anchor.
    If all the bytes of a range's windows are seen twice, all its windows are
    repeats; if the bytes that they have in common are seen once, none is. What is
    left, and one of each that was found, is cut in two, down to single windows. Bytes are compared by
    128-bit hashes, counted with a map-side part.
    """
    spans = None
    size = 1 << max((length - ANCHOR).bit_length() - 1, 0)
    starts = F.array(*[F.lit(j) for j in range(0, length - ANCHOR + 1, size)])
    state = contexts.withColumn("j", F.explode(starts))

    def hashed(size):
        def ranges(batches):
            for b in batches:
                out = []
                for row in zip(*(b.column(n).to_pylist() for n in _RANGES.names[:10])):
                    _, twice, _, _, _, _, span, at, data, j = row
                    first, last = at - j - size + 1, at - j  # windows of the range, by their place in the bytes
                    if last < 0 or first > span:
                        continue
                    whole = 0 <= first and last <= span
                    out.append((
                        *row, whole, *_halves(xxhash.xxh3_128_intdigest(data[first : last + length], j) if whole else 0),
                        *_halves(xxhash.xxh3_128_intdigest(data[last : first + length], j)),
                    ))
                if out:
                    yield batch(_RANGES, *map(list, zip(*out)))

        return ranges

    while True:
        rows = cut_lineage(state.select(*_RANGES.names[:10]).mapInArrow(hashed(size), _ddl(_RANGES)))
        groups = cut_lineage(rows.filter("whole").groupBy("u1", "u2").agg(
            ((F.count("*") > 1) | F.max("twice")).alias("again")
        ))
        begin = F.col("lo") + F.col("at") - F.col("j") - size + 1
        found = rows.filter("whole and not twice").join(groups.filter("again"), ["u1", "u2"], "left_semi").select(
            "chunk", "k1", "k2", begin.alias("begin"), (begin + size - 1 + length).alias("stop")
        )
        spans = found if spans is None else spans.unionByName(found)
        if size == 1:
            return spans
        # one row of each group goes on, as a partner for those that have only a part of its bytes
        ones = rows.filter("whole").dropDuplicates(["u1", "u2"]).join(groups, ["u1", "u2"]).drop("twice")
        left = cut_lineage(
            ones.withColumnRenamed("again", "twice").select(*_RANGES.names).unionByName(rows.filter("not whole"))
        )
        core = cut_lineage(left.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c1", "c2"))
        state = cut_lineage(left.join(core, ["c1", "c2"], "left_semi").withColumn(
            "j", F.explode(F.array(F.col("j"), F.col("j") + size // 2))
        ))
        size //= 2


def _halves(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(chunk, k1, k2, begin, stop): byte ranges of `rows` that strings of `length` bytes cover that also start elsewhere.

    Equal strings share their anchor, so only anchors are moved, one in some 170
    bytes at a length of 400. Where all the bytes around an anchor are seen twice nothing is left to
    compare. Else one of each different surrounding meets the others of its
    anchor, which is sorted there; for anchors with more than CROWD surroundings
    ranges of windows are counted instead, so that no task gets a whole crowd.
    Every chunk also has a row without a range.
    """
    found = cut_lineage(_anchor_rows(rows, length))
    chunks = cut_lineage(found.filter("anchor is null").select("chunk").distinct())
    found = found.filter("anchor is not null")
    common = cut_lineage(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    found = cut_lineage(found.join(common, "anchor", "left_semi"))
    place = F.struct("chunk", "k1", "k2", "lo", "span", "at")
    kinds = cut_lineage(found.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    full = found.join(kinds.filter("n > 1").select("anchor", "around"), ["anchor", "around"]).select(
        "chunk", "k1", "k2", F.col("lo").alias("begin"), (F.col("lo") + F.col("span") + length).alias("stop")
    )
    crowds = cut_lineage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    contested = kinds.join(crowds, "anchor").select(
        "anchor", "around", (F.col("n") > 1).alias("twice"), (F.col("kinds") > CROWD).alias("crowded"), "one.*"
    )
    contexts = cut_lineage(_contexts(rows, contested, chunks, length))
    spans = full.unionByName(_sorted_spans(contexts.filter("not crowded"), length)).unionByName(chunks, allowMissingColumns=True)
    crowded = contexts.filter("crowded")
    return spans if crowded.isEmpty() else spans.unionByName(_crowd_spans(crowded, length))


def _prepared(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> tuple[DataFrame, str]:
    if length < ANCHOR:
        raise ValueError(f"a repeat has {ANCHOR} bytes at least")
    docs, chunk = placed(docs.select(id_col, text_col))
    keys = F.xxhash64(F.col(id_col)).alias("more_0"), raw_hash(text_col).alias("more_1")
    rows = worker_texts(docs, id_col, text_col, chunk, *keys)
    return rows, write_dictionary(repeated_spans(rows, length), "suffix-spans")


def _cut_out(data: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    spans = merge(sorted(spans))
    at, kept = 0, []
    for begin, stop in spans:
        kept.append(data[at:begin])
        at = stop
    return b"".join([*kept, data[at:]]), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Removed is every byte covered by a string of `length` bytes that also starts
    anywhere else in the table, in the same document too. Null is empty; shorter
    texts lose nothing; of repeated rows each loses what the others hold. An
    empty table gives no rows; other columns are ignored, whatever their names.
    Rows are best read from Parquet files (filters and projections aside); others
    are written to some first.
    """
    rows, folder = _prepared(docs, id_col, text_col, length)

    def cut(batches):
        dictionaries = Dictionaries(folder, lambda t: _by_row(t, ("begin", "stop")))
        for b in batches:
            for chunk, part in parts(b):
                spans, out = dictionaries[chunk], []
                for doc_id, k1, k2, data in zip(*(part.column(n).to_pylist() for n in ("doc_id", "more_0", "more_1", "text"))):
                    kept, own = _cut_out(data, spans.get((k1, k2), ()))
                    out.append((doc_id, len(data), len(data) - len(kept), len(own), kept))
                yield batch(_RESULT, *map(list, zip(*out)))

    return rows.mapInArrow(cut, _ddl(_RESULT))


def digests(results: DataFrame) -> DataFrame:
    return results.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def shorten(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", chars_col: str = "n_chars", length: int = LENGTH
) -> DataFrame:
    """`docs` with its repeats taken out of the text, all other columns as they are; the length column follows.

    A character of which a byte is removed goes whole, so that the text stays valid. Null texts stay null.
    """
    docs, chunk = placed(docs)
    _, folder = _prepared(docs, id_col, text_col, length)
    names, schema = docs.columns, docs.schema
    keyed = docs.select("*", chunk.alias("__chunk"), F.xxhash64(F.col(id_col)).alias("__k1"), raw_hash(text_col).alias("__k2"))

    def cut(batches):
        dictionaries = Dictionaries(folder, lambda t: _by_row(t, ("begin", "stop")))
        for b in batches:
            texts = b.column(text_col).to_pylist()
            keys = zip(*(b.column(n).to_pylist() for n in ("__chunk", "__k1", "__k2")))
            for i, (chunk, k1, k2) in enumerate(keys):
                if (spans := dictionaries[chunk].get((k1, k2))) and texts[i]:
                    texts[i] = _cut_out(texts[i].encode(), spans)[0].decode(errors="ignore")
            columns = {n: b.column(n) for n in names}
            columns[text_col] = pa.array(texts, pa.string())
            if chars_col in columns:
                columns[chars_col] = pa.array([None if t is None else len(t) for t in texts], columns[chars_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return keyed.mapInArrow(cut, schema)
