"""A bigram language model whose counts lie in a log-frequency Bloom filter, and unigram counts per chunk."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.chunks import FLUSH_WORDS, Dictionaries, chunked, parts, write_dictionary
from runlens.llm.shared import batch, cut_lineage, mix, release_memory, shuffles_dropped, slices

#: Bits of the filter per entry and probes per level; the base of the count levels is 2.
BITS_EACH, PROBES = 10, 5
#: Weight of a history seen c times: WEIGHT * c / (c + HALF).
WEIGHT, HALF = 0.3, 2.0
#: Bigrams of one shard of the filter on average, the fewest shards, and the bytes of the filter's answers a worker keeps at once.
SHARD_BIGRAMS, LEAST_SHARDS, BROADCAST_BYTES = 1 << 20, 256, 64 << 20
#: Bigrams a task gathers before it sorts them, those it hands on at once, and bytes of text whose words it holds at once.
GATHER, HAND_ON, SLICE_BYTES = 4_000_000, 1 << 19, 1 << 20

_START, _END = np.uint64(0x51AB1E5EED), np.uint64(0x0E0D0F7E47)
_COUNTS = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
_BLOBS = pa.schema([("span", pa.int64()), ("shard", pa.int32()), ("learned", pa.bool_()), ("blob", pa.binary())])
_ANSWERS = pa.schema([
    ("chunk", pa.int64()), ("shard", pa.int32()), ("learned", pa.bool_()), ("whole", pa.bool_()), ("names", pa.binary()), ("levels", pa.binary()),
])
_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
_SCORES = pa.schema([
    ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
])


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, parted by ASCII white space."""
    return text.lower().split()


def _numbered(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words in `known`, which grows by those that are new."""
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def chunk_counts(rows: DataFrame) -> DataFrame:
    """(chunk, word, n): every word of a chunk and how often the training rows hold it; word null: training rows."""

    def counted(batches):
        from collections import Counter

        held: dict[int, Counter] = {}

        def flush():
            for chunk, counts in held.items():
                items = list(counts.items())
                for at in range(0, len(items), 50_000):
                    some = items[at : at + 50_000]
                    yield batch(_COUNTS, np.full(len(some), chunk), [w for w, _ in some], [n for _, n in some])
            held.clear()

        for b in batches:
            for chunk, some in parts(b):
                counts = held.setdefault(chunk, Counter())
                for text, train in zip(some.column("text").to_pylist(), some.column("more_0").to_pylist()):
                    if train:
                        counts.update(words_of(text))
                        counts[None] += 1
                    else:
                        counts.update(dict.fromkeys(words_of(text), 0))
            if sum(map(len, held.values())) > FLUSH_WORDS:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(counted, "chunk long, word binary, n long")


def _pairs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bigrams of texts laid end to end; `ends`: one past each text's last word. Every text
    opens after a start mark and closes with an end mark."""
    tokens = np.insert(codes, ends, _END)
    stops = ends + np.arange(1, len(ends) + 1)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], stops[:-1]))] = _START
    return mix(mix(before) + tokens)


def _codes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _laid(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    lists = [words_of(t) for t in texts]
    numbers = _numbered([w for words in lists for w in words], known)
    return numbers, np.cumsum([len(words) for words in lists])


def _by_span(spans, trains, lengths: np.ndarray):
    """(span, train, which): the items of every span's training rows, and of its others; `lengths`: items of each row."""
    names = list(zip(spans, trains))
    if len(groups := dict.fromkeys(names)) == 1:
        yield *names[0], slice(None)
        return
    number = {g: i for i, g in enumerate(groups)}
    of = np.repeat([number[x] for x in names], lengths)
    for g, i in number.items():
        yield *g, of == i


def bigram_blobs(rows: DataFrame, shards: int) -> DataFrame:
    """(span, shard, learned, blob): distinct hashed bigrams of what a task has read of a span.

    Those of the training rows come with their counts (`learned`), those of the other rows apart, with counts of 0.
    Without a column `span` all rows are of one.
    """
    shift = np.uint64(64 - (shards.bit_length() - 1))
    if "span" not in rows.columns:
        rows = rows.withColumn("span", F.lit(0).cast("long"))

    def gathered(batches):
        held: dict[tuple, list] = {}
        size = 0
        release_memory()

        def flush():
            while held:
                (span, train), some = held.popitem()
                keys = np.concatenate(some)
                some.clear()
                keys.sort()
                starts = _starts(keys)
                counts = np.diff(np.append(starts, len(keys))) if train else np.zeros(len(starts), np.int64)
                keys = keys[starts]
                shard = (keys >> shift).astype(np.int64)
                first = _starts(shard)
                stops = np.append(first[1:], len(keys))
                for part in np.split(np.arange(len(first)), _starts(stops // HAND_ON)[1:]):
                    blobs = [_blob(keys[i:j], counts[i:j]) for i, j in zip(first[part], stops[part])]
                    yield batch(_BLOBS, [span] * len(blobs), shard[first[part]], [train] * len(blobs), blobs)

        for b in batches:
            texts, spans, trains = (b.column(n).to_pylist() for n in ("text", "span", "more_0"))
            for i, j in slices(texts, SLICE_BYTES):
                known: dict[bytes, int] = {}
                numbers, ends = _laid(texts[i:j], known)
                keys = _pairs(_codes(known)[numbers], ends)
                for span, train, which in _by_span(spans[i:j], trains[i:j], np.diff(ends, prepend=0) + 1):
                    held.setdefault((span, train), []).append(keys[which])
                size += len(keys)
                if size > GATHER:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.mapInArrow(gathered, "span long, shard int, learned boolean, blob binary")


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))


def _planes(numbers: np.ndarray) -> bytes:
    """First the lowest bytes of all, then the next: sorted numbers, and small ones, compress as they do not number by number."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    own = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(own.itemsize, -1).T).view(own)[:, 0]


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return np.int64(len(keys)).tobytes() + _planes(keys.astype("<u8")) + _planes(counts.astype("<u4"))


def _read_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    return _numbers(blob[8 : 8 + 8 * n], "<u8"), _numbers(blob[8 + 8 * n :], "<u4")


def _positions(keys: np.ndarray, level: int, probe: int, size) -> np.ndarray:
    salt = np.uint64((level * 64 + probe + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return mix(keys ^ salt) % size


def levels(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7 and so on."""
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def least_counts(level: np.ndarray) -> np.ndarray:
    """The least count of each level (0: not entered). Taken for the counts of a history's successors they come to the
    count of the history at most."""
    return np.where(level > 0, 2.0 ** (level - 1), 0.0)


def _summed(blobs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams of (keys, counts), their counts, and where in the first each of the given ones is."""
    keys, where = np.unique(np.concatenate([k for k, _ in blobs]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in blobs])).astype(np.int64), where


def _segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter's bits for a shard's distinct bigrams. A bigram of level q is entered as (bigram, 1) to (bigram, q)."""
    level = levels(counts)
    size = np.uint64(-(-int(level.sum()) * BITS_EACH // 8) * 8)
    bits = np.zeros(int(size), bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= q]
        for k in range(PROBES):
            bits[_positions(some, q, k, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def build_filter(blobs: DataFrame) -> DataFrame:
    """(shard, bits): the segments of the log-frequency Bloom filter."""

    def built(part: pa.Table) -> pa.Table:
        keys, counts, _ = _summed([tuple(_read_blob(x)) for x in part.column("blob").to_pylist()])
        return pa.table({
            "shard": pa.array([part.column("shard")[0].as_py()], pa.int32()),
            "bits": pa.array([_segment(keys[counts > 0], counts[counts > 0])], pa.binary()),
        })

    return blobs.groupBy("shard").applyInArrow(built, "shard int, bits binary")


def filter_levels(blobs: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, learned, whole, names, levels): what the filter says of the bigrams of each span (here: chunk), by the
    rows that hold them.

    Learned bigrams are entered, so only those whose level is over 1 are named; of the others, those whose level is over
    0. A name is the 32 bits below the shard's, or the `whole` bigram where two of the span's agree in them. Each segment
    of the filter is built where its shard's bigrams meet, asked there and dropped: a task holds one segment and the
    learned bigrams of its shard, whatever the size of the filter and the number of bigrams to ask for.
    """
    low = _name_shift(shards)

    def asked(batches):
        now, probe = None, None
        held: list[tuple] = []

        def answers(learned, level):
            at, by_span = 0, {}
            for span, keys, _ in held:
                by_span.setdefault(span, []).append((keys, level[at : at + len(keys)]))
                at += len(keys)
            held.clear()
            out = [[span, now, learned, *_named(some, learned, low)] for span, some in by_span.items()]
            return batch(_ANSWERS, *map(list, zip(*out)))

        def learn():
            keys, counts, where = _summed([(k, n) for _, k, n in held])
            some = Filter(shards, {now: _segment(keys, counts)})
            return some, answers(True, some.levels(keys)[where])

        def ask():
            keys = np.concatenate([k for _, k, _ in held])
            return answers(False, probe.levels(keys) if probe else np.zeros(len(keys), np.int64))

        size, learning = 0, True
        for b in batches:
            for span, shard, learned, blob in zip(*(b.column(n).to_pylist() for n in _BLOBS.names)):
                enough = not learning and size > SHARD_BIGRAMS and span != held[-1][0]
                if held and (shard != now or learned != learning or enough):
                    if learning:
                        probe, out = learn()
                    else:
                        out = ask()
                    size = 0
                    yield out
                if shard != now:
                    now, probe = shard, None
                learning = learned
                held.append((span, *_read_blob(blob)))
                size += len(held[-1][1])
        if held:
            yield learn()[1] if learning else ask()

    rows = blobs.repartition("shard").sortWithinPartitions("shard", F.desc("learned"), "span")
    return rows.mapInArrow(asked, ", ".join(f"{f.name} {_SPARK[f.type]}" for f in _ANSWERS))


def _name_shift(shards: int) -> np.uint64:
    return np.uint64(max(0, 64 - (shards.bit_length() - 1) - 32))


def _named(blobs: list[tuple], learned: bool, low: np.uint64) -> tuple[bool, bytes, bytes]:
    """(whole, names, levels) of all bigrams of one span and shard, given as sorted (keys, levels)."""
    keys, level = blobs[0]
    if len(blobs) > 1:
        keys, first = np.unique(np.concatenate([k for k, _ in blobs]), return_index=True)
        level = np.concatenate([n for _, n in blobs])[first]
    short = (keys >> low).astype("<u4")
    whole = bool((short[1:] == short[:-1]).any())
    told = level > learned
    return whole, _planes((keys if whole else short)[told]), level[told].astype(np.uint8).tobytes()


class Filter:
    """Some segments of the filter, ready to be probed."""

    def __init__(self, shards: int, segments: dict[int, bytes]):
        self.shift = np.uint64(64 - (shards.bit_length() - 1))
        self.sizes, self.bases = np.zeros(shards, np.uint64), np.zeros(shards, np.uint64)
        at = 0
        for shard, bits in segments.items():
            self.sizes[shard], self.bases[shard] = 8 * len(bits), 8 * at
            at += len(bits)
        self.held = np.zeros(shards, bool)
        self.held[list(segments)] = True
        self.bits = np.frombuffer(b"".join(segments.values()), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each bigram by membership probes: the last of the levels 1, 2, ... that are all entered."""
        found = np.zeros(len(keys), np.int64)
        shard = (keys >> self.shift).astype(np.int64)
        open_ = np.flatnonzero(self.held[shard] & (self.sizes[shard] > 0))
        q = 1
        while len(open_):
            for k in range(PROBES):
                some = shard[open_]
                at = self.bases[some] + _positions(keys[open_], q, k, self.sizes[some])
                open_ = open_[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            found[open_] = q
            q += 1
        return found


class Answers:
    """A task's view of what `filter_levels` wrote: as many spans as `budget` bytes hold, the last in use, but one at least."""

    def __init__(self, folder: str, shards: int, budget: int):
        self.files, self.budget, self.held = Dictionaries(folder, self._loaded), budget, {}
        self.shards, self.shift, self.low = shards, np.uint64(64 - (shards.bit_length() - 1)), _name_shift(shards)

    def _loaded(self, part: pa.Table) -> dict[bool, tuple[np.ndarray, ...]]:
        """By learned: the shards whose bigrams have whole names; the names, sorted, as bigrams without the bits that they lack; levels."""
        columns = [part.column(n).to_pylist() for n in _ANSWERS.names[1:]]
        found = {kind: (np.zeros(self.shards, bool), [np.empty(0, np.uint64)], [b""]) for kind in (True, False)}
        for shard, learned, whole, names, level in sorted(zip(*columns), key=lambda row: row[0]):
            wholes, keys, told = found[learned]
            wholes[shard] = whole
            own = _numbers(names, "<u8" if whole else "<u4").astype(np.uint64)
            keys.append(own if whole else own << self.low | np.uint64(shard) << self.shift)
            told.append(level)
        return {kind: (w, np.concatenate(k), np.frombuffer(b"".join(n), np.uint8)) for kind, (w, k, n) in found.items()}

    def levels(self, span: int, learned: bool, keys: np.ndarray) -> np.ndarray:
        if (found := self.held.pop(span, None)) is None:
            found = self.files[span]
            self.files.held = (None, None)
        self.held[span] = found
        while len(self.held) > 1 and sum(a.nbytes for some in self.held.values() for kind in some.values() for a in kind) > self.budget:
            del self.held[next(iter(self.held))]
        whole, names, level = found[learned]
        out = np.full(len(keys), int(learned))
        if len(names):
            order = np.argsort(keys)
            keys = keys[order]
            own = keys >> self.low << self.low
            if whole.any():
                own = np.where(whole[(keys >> self.shift).astype(np.int64)], keys, own)
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            out[order] = np.where(names[at] == own, level[at], int(learned))
        return out


def score(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Learns from the rows where `training` holds (null: not) and scores all rows, whole texts, null as empty.

    Tokens are words and one end. Returns doc_id, train, n_tokens, n_known (tokens
    that the training rows hold), train_tokens, base_score (smoothed unigrams) and
    score, log10 of the chance that the model gives the text: for each token a
    mixture of its share after the token before it and the unigram chance. Shares are
    taken from the least count of a bigram's level, so those of a history's successors
    come to one at most, but for what the filter's false entries add. With
    nothing to learn from both scores are those of add-half smoothing over no
    tokens. Repeated rows and null ids come out as they go in; an empty table
    gives no rows; other columns are ignored. See `chunks` for what `docs` may be.

    Unigram counts are exact and come by chunk dictionaries. Bigrams are summed in
    shards by hash, where the shard's segment of the Bloom filter is built and asked
    for every bigram of the texts; its answers come back by dictionaries of `chunks`'s
    spans, of which a worker keeps `budget` bytes. The texts are read three times,
    whatever the size of the filter.
    """
    rows = chunked(docs, id_col, text_col, F.coalesce(training, F.lit(False)))
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        counts = cut_lineage(chunk_counts(rows))
        totals = cut_lineage(counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")))
    ends = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    words, distinct = totals.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n_all, n_distinct = int(words or 0) + ends, distinct + (ends > 0)
    shards = LEAST_SHARDS
    while shards * SHARD_BIGRAMS < n_all:
        shards *= 2
    with shuffles_dropped(spark):
        folder = write_dictionary(
            counts.filter("word is not null").select("chunk", "word").join(totals, "word"), "lm-words"
        )
        answers = write_dictionary(filter_levels(bigram_blobs(rows, shards), shards), "lm-bigrams") if n_all else None
    below = n_all + 0.5 * (n_distinct + 1)

    def loaded(part: pa.Table):
        names = part.column("word").to_pylist()
        index = dict(zip(names, range(len(names))))
        c = part.column("c").to_numpy().astype(np.float64)
        return index, c, _codes(names)

    def scored(batches):
        dictionaries = Dictionaries(folder, loaded)
        said = Answers(answers, shards, budget) if answers else None
        now, found = None, None
        release_memory()
        for b in batches:
            for chunk, whole in parts(b):
                if chunk != now:
                    now, found = chunk, None  # before the next is read, not after
                    if said:
                        said.held.clear()
                    found = dictionaries[chunk]
                texts = whole.column("text").to_pylist()
                for i, j in slices(texts, SLICE_BYTES):
                    yield judged(texts[i:j], whole.slice(i, j - i), *found, said)

    def judged(texts, part, index, c, codes, said):
        lists = [words_of(t) for t in texts]
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64)
        ends_at = np.cumsum([len(words) for words in lists])
        count = np.insert(c[at], ends_at, ends)
        stops = ends_at + np.arange(1, len(ends_at) + 1)
        begins = np.concatenate(([0], stops[:-1]))
        unigram = (count + 0.5) / below
        keys = _pairs(codes[at], ends_at)
        history = np.empty_like(count)
        history[1:] = count[:-1]
        history[begins] = ends
        level = np.zeros(len(keys), np.int64)
        if said:
            for span, train, which in _by_span(part.column("span").to_pylist(), part.column("more_0").to_pylist(), stops - begins):
                level[which] = said.levels(span, train, keys[which])
        seen = np.minimum(least_counts(level), history)
        weight = WEIGHT * history / (history + HALF)
        chance = weight * seen / np.maximum(history, 1) + (1 - weight) * unigram
        return batch(
            _SCORES, part.column("doc_id"), part.column("more_0"), stops - begins,
            np.add.reduceat(count > 0, begins, dtype=np.int64),
            np.add.reduceat(np.log10(unigram), begins), np.add.reduceat(np.log10(chance), begins),
        )

    out = rows.mapInArrow(scored, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
