"""Byte-level BPE as a fold of ranked merges, over each distinct match of the pattern once; and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.chunks import FLUSH_WORDS, Dictionaries, chunked, parts, write_dictionary
from runlens.llm.pieces import MARK, Parts, marked, strings
from runlens.llm.shared import batch, slices

#: Buckets of the rank map, and bytes of a match beyond which its merges are made in a heap.
BUCKETS, LONG_MATCH = 1 << 14, 64
#: Words of a chunk whose ids a task keeps, and bytes of text it codes at once.
KEPT_WORDS, SLICE_BYTES = 200_000, 4 << 20

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = f" [{WHITE_SPACE}]|[{WHITE_SPACE}] "
_WORD = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

_MATCHES = pa.schema([("chunk", pa.int64()), ("match", pa.string())])
_BYTES = pa.schema([("match", pa.string()), ("bytes", pa.list_(pa.string())), ("chunks", pa.list_(pa.int64()))])
_ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()),
])
_DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def marked_words(texts: pa.Array) -> pa.Array:
    """UTF-8 texts with MARK between words: white space and what follows it. No match of the pattern reaches over a
    word's end, for a match that holds other characters than white space ends before white space."""
    column = texts.cast(pa.large_binary())
    odd = pc.match_substring_regex(column.cast(pa.large_string()), _ODD)
    found = [MARK.join(map(str.encode, _WORD.findall(t.decode()))) for t in strings(column.filter(odd))]
    return pc.replace_with_mask(pc.replace_substring(column, b" ", MARK + b" "), odd, pa.array(found, pa.large_binary()))


def merge_long(match: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of a long match after all merges, by a heap over neighbours: n log n, not n squared."""
    n = len(match)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(match[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(match[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [match[i : end[i]] for i in range(n) if alive[i]]


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of small maps from a part in hex digits to its rank.

    Spark looks a key up in a map by going through it, so the map is cut into
    buckets by a hash that the lookup computes too.
    """
    rows = spark.createDataFrame([(k.hex(), v) for k, v in ranks.items()], "part string, id int")
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for b, part, number in rows.select(_bucket(F.col("part")), "part", "id").collect():
        buckets[b][part] = number
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def _bucket(part: Column) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(BUCKETS)).cast("int")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once and stands in the plan once."""
    return F.get(F.transform(F.array(value), body), 0)


def merged(match: Column, ranks: Column) -> Column:
    """The ids of one match after all merges; `match` is an array of its bytes in hex digits.

    A fold over as many steps as there are gaps between bytes: each step joins the
    neighbours with the lowest rank, the leftmost of them, ranks the new part with
    its own neighbours, and changes nothing once no neighbours can be joined.
    """

    def fold(table: Column) -> Column:
        def rank(part: Column) -> Column:
            return F.try_element_at(F.element_at(table, _bucket(part) + 1), part)

        def joined(state: Column, at: Column, one: Column) -> Column:
            held, scores = state["held"], state["scores"]
            left = F.when(at > 1, F.array(rank(F.concat(F.get(held, at - 2), one)))).otherwise(none)
            right = F.when(at + 1 < F.size(held), F.array(rank(F.concat(one, F.get(held, at + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(held, F.lit(1), at - 1), F.array(one), F.slice(held, at + 2, F.size(held))).alias("held"),
                F.concat(
                    F.slice(scores, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right,
                    F.slice(scores, at + 2, F.size(held)),
                ).alias("scores"),
            )

        def step(state: Column, _: Column) -> Column:
            def lowest(at: Column) -> Column:
                pair = F.concat(F.get(state["held"], at - 1), F.get(state["held"], at))
                return F.when(at.isNull(), state).otherwise(_let(pair, lambda one: joined(state, at, one)))

            return _let(F.array_position(state["scores"], F.array_min(state["scores"])).cast("int"), lowest)

        none = F.array().cast("array<int>")
        gaps = F.size(match) - 1
        first = F.zip_with(
            F.slice(match, F.lit(1), gaps), F.slice(match, F.lit(2), gaps), lambda a, b: rank(F.concat(a, b))
        )
        whole = rank(F.array_join(match, ""))
        return F.when((gaps < 1) | whole.isNotNull(), F.array(whole)).otherwise(F.aggregate(
            F.sequence(F.lit(1), gaps), F.struct(match.alias("held"), first.alias("scores")), step,
            lambda state: F.transform(state["held"], rank),
        ))

    return _let(ranks, fold)


class WordIds(dict):
    """Ids of the words of a chunk, put together from those of their matches when first asked for."""

    def __init__(self, ids_of: dict[str, bytes], pattern: str):
        import regex

        self.ids_of, self.findall = ids_of, regex.compile(pattern).findall

    @property
    def of(self):
        """The lookup; what is kept of earlier words is dropped once it is much."""
        if len(self) > KEPT_WORDS:
            self.clear()
        return self.__getitem__

    def __missing__(self, word: str) -> bytes:
        self[word] = found = b"".join(map(self.ids_of.__getitem__, self.findall(word)))
        return found


def chunk_matches(docs: DataFrame, pattern: str) -> DataFrame:
    """(chunk, match): the distinct matches of the pattern in every chunk of `chunked` rows."""

    def gathered(batches):
        import regex

        of = regex.compile(pattern).findall
        held: dict[int, set] = {}

        def flush():
            for chunk, words in held.items():
                matches = list({m for w in words for m in of(w)})
                for at in range(0, len(matches), 50_000):
                    some = matches[at : at + 50_000]
                    yield batch(_MATCHES, np.full(len(some), chunk), some)
            held.clear()

        for b in batches:
            for chunk, rows in parts(b):
                held.setdefault(chunk, set()).update(marked(marked_words(rows.column("text")), MARK)[0])
            if sum(map(len, held.values())) > FLUSH_WORDS:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(gathered, "chunk long, match string")


def match_ids(matches: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(match, ids, chunks) of a table of distinct matches and their chunks; ids are three bytes each, the first the highest."""
    shared = matches.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size is that of its file

    def cut(batches):
        single = [bytes([i]).hex() for i in range(256)]
        for b in batches:
            texts = b.column("match")
            yield batch(_BYTES, texts, [
                [single[i] for i in m] if len(m) <= LONG_MATCH else [p.hex() for p in merge_long(m, shared.value)]
                for m in map(str.encode, strings(texts))
            ], b.column("chunks"))

    rows = matches.mapInArrow(cut, "match string, bytes array<string>, chunks array<long>")
    ids = merged(F.col("bytes"), rank_map(matches.sparkSession, ranks))
    packed = F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 6, "0")), ""))
    return rows.select("match", packed.alias("ids"), "chunks")


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encodes every whole text and decodes it again: doc_id, ids (binary, 32 bits each), decoded (binary).

    With `digests` the ids' number and digests instead of them. Null texts are
    empty; they and empty texts have no ids. Rows that repeat come out as often.
    An empty table gives no rows; other columns are ignored, whatever their names.
    See `chunks` for what `docs` may be.

    Each distinct match of the pattern in the corpus is encoded once, by DataFrame
    functions; what it gives goes back to the chunks that hold the match.
    """
    ranks = read_ranks(ranks_path)
    rows = chunked(docs, id_col, text_col)
    # a match and the chunks that hold it, as many at most as there are splits, meet once: there it is encoded
    matches = chunk_matches(rows, pattern).repartition("match").groupBy("match").agg(F.collect_list("chunk").alias("chunks"))
    encoded = match_ids(matches, ranks).select("match", "ids", F.explode("chunks").alias("chunk"))
    folder = write_dictionary(encoded, "bpe-matches")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def loaded(table: pa.Table) -> WordIds:
        ids_of: dict[str, bytes] = {}
        for b in table.select(["match", "ids"]).to_batches():
            packed = strings(b.column("ids"))
            flat = np.frombuffer(b"\0" + b"".join(packed), np.uint8)[1:].reshape(-1, 3).astype("<u4")
            flat = (flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]).astype("<u4").tobytes()
            stops = (np.cumsum([len(x) for x in packed]) // 3 * 4).tolist()
            ids_of.update(zip(strings(b.column("match")), (flat[i:j] for i, j in zip([0, *stops], stops))))
        return WordIds(ids_of, pattern)

    def coded(batches):
        dictionaries = Dictionaries(folder, loaded)
        pieces = [b""] * (max(shared.value.values(), default=-1) + 1)
        for piece, number in shared.value.items():
            pieces[number] = piece
        vocabulary = Parts(pieces)
        for b in batches:
            for chunk, some in parts(b):
                words = dictionaries[chunk]
                texts = some.column("text")
                for i, j in slices(strings(texts), SLICE_BYTES):
                    wanted, numbers, stops = marked(marked_words(texts.slice(i, j - i)), MARK)
                    ids = Parts(list(map(words.of, wanted)), 4).laid(numbers, stops)
                    counts = [len(x) // 4 for x in ids]
                    back = vocabulary.laid(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(counts))
                    doc_ids = some.column("doc_id").slice(i, j - i)
                    if digests:
                        sums = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, back)]
                        yield batch(_DIGESTS, doc_ids, counts, *sums)
                    else:
                        yield batch(_ENCODED, doc_ids, ids, back)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else (
        "doc_id long, ids binary, decoded binary")
    return rows.mapInArrow(coded, schema)
