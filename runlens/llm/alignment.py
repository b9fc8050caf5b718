"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Rows of a token-byte incidence matrix are tokens, columns the bytes they cover;
A·Bᵀ links the tokens of A and B that overlap, its values are the bytes they share.
Places where a token of A and one of B both end cut the text into groups; the
product of the token-group matrices links all tokens that share a group. The
matrices are compressed rows built here, their products Gustavson's, row by row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.chunks import Dictionaries, parts, placed, write_dictionary
from runlens.llm.shared import batch, cut_lineage, no_collection, shared_folder, slices, worker_texts
from runlens.llm.word_cache import WordCache

#: Bytes of one generation of the pieces a worker keeps (there are two), what one takes beside eight a letter, letters of
#: the longest kept, and bytes of text encoded at once.
CACHE_BYTES, PIECE_BYTES, CACHE_LONGEST, SLICE_BYTES = 128 << 20, 330, 48, 2 << 20
#: Matrix entries that one block of a product makes at most (one row may make more).
PRODUCT_BLOCK = 1 << 20
#: Links a task counts at once; a pair of ids may leave it once for each such lot.
COUNT_LINKS = 1 << 22

_ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()),
])
_LINKS = pa.schema([
    ("doc_id", pa.int64()), ("a_index", pa.int64()), ("b_index", pa.int64()), ("a_id", pa.int64()), ("b_id", pa.int64()),
    ("shared_bytes", pa.int64()),
])
_PAIRS = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])


@dataclass
class Csr:
    """A matrix in compressed rows: row i holds `values[j]` in column `columns[j]` for starts[i] <= j < starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        row_of = np.repeat(np.arange(self.rows), np.diff(self.starts))
        starts = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=starts[1:])
        return Csr(starts, row_of[order], self.values[order], self.rows)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens against the bytes they cover, laid end to end."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def token_groups(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Tokens against the one group each lies in; `cuts` are the ends of the groups."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), np.ones(len(ends), np.int64), len(cuts))


def product_blocks(a: Csr, b: Csr):
    """a·b in blocks of rows: (rows, columns, values) of the entries that are not zero, by row and column.

    Row i of the product is the sum of the rows of b that row i of a names, each
    times a's value there.
    """
    made = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])  # entries of b's rows up to each entry of a
    upto = made[a.starts]
    first = 0
    while first < a.rows:
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + PRODUCT_BLOCK, "right")) - 1)
        own = slice(a.starts[first], a.starts[last])
        begin = b.starts[a.columns[own]]
        many = b.starts[a.columns[own] + 1] - begin
        at = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
        row = np.repeat(np.repeat(np.arange(first, last), np.diff(a.starts[first : last + 1])), many)
        key = row * b.width + b.columns[at]
        value = np.repeat(a.values[own], many) * b.values[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        if len(key):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, value = key[new], np.add.reduceat(value, new)
        yield key // b.width, key % b.width, value
        first = last


class Tokenizers:
    """Both vocabularies: ids and bytes of tokens of a piece, and what is known of pieces seen before.

    A text is cut before a space that stands between two characters that are no
    white space. No token of A reaches over such a place, by its word pattern, and
    none of B, where no entry holds a space after another character (otherwise
    texts stay whole). So a text's tokens are those of its pieces, each read with the
    space before it.
    """

    def __init__(self, a_path: str, b_path: str):
        import re

        from sentencepiece import SentencePieceProcessor

        self.words = WordCache(a_path, spaces=True, lower=False)
        self.a = self.words.library
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=b_path)
        shown = _byte_alphabet()
        names = {i: token for token, i in self.a.get_vocab().items()}
        self.n_a, self.n_b = max(names, default=0) + 1, self.b.get_piece_size()
        self.a_bytes = [bytes(shown[c] for c in names[i]) if i in names and all(c in shown for c in names[i]) else b"" for i in range(self.n_a)]
        entries = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(entries)
        ]
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)
        self.cuttable = not any("▁" in p.lstrip("▁") for p in entries)
        self.crowded, self.cut = re.compile(r"\x20\s|\s\x20|^\x20|\x20$"), re.compile(r"(?<=\S)\x20(?=\S)")
        self.kind = "<u4" if self.n_a * self.n_b <= 1 << 32 else "<u8"
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.size = 0

    def pieces(self, text: str) -> list[str]:
        if not self.cuttable:
            return [text]
        return self.cut.split(text) if self.crowded.search(text) else text.split(" ")

    def _a_ids(self, spaced: list[str]) -> list[np.ndarray]:
        rare = self.words.rare.search
        plain = [s[:1] == " " and s[1:].isalpha() and (s.isascii() or not rare(s)) for s in spaced]
        fast = iter(self.words._words([s[1:] for s, p in zip(spaced, plain) if p]))
        slow = iter(self.words._raw([s for s, p in zip(spaced, plain) if not p]))
        return [np.frombuffer(next(fast if p else slow), self.words.kind) for p in plain]

    def encoded(self, spaced: list[str]) -> tuple[list, list, list[bool]]:
        """Ids of both for each text, which begins with the space that B puts there itself, and whether both say just that."""
        a = self._a_ids(spaced)
        b = self.b.encode([s[1:] for s in spaced], num_threads=1)
        raw = [s.encode() for s in spaced]
        of_a, of_b, whole = self.a_bytes.__getitem__, self.b_bytes.__getitem__, b"".join(raw)
        sizes = [len(x) for x in raw]
        flat_a = np.concatenate(a).tolist() if a else []
        flat_b = chain.from_iterable(b)
        if b"".join(map(of_a, flat_a)) == whole == b"".join(map(of_b, flat_b)) and self._ends(a, self.a_lengths) == sizes == self._ends(b, self.b_lengths):
            return a, b, [True] * len(a)
        return a, b, [b"".join(map(of_a, x.tolist())) == r == b"".join(map(of_b, y)) for r, x, y in zip(raw, a, b)]

    @staticmethod
    def _ends(ids: list, lengths: np.ndarray) -> list[int]:
        """Bytes of each text's tokens."""
        at = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, at[-1])
        upto = np.concatenate([[0], np.cumsum(lengths[flat])])
        return np.diff(upto[at]).tolist()

    def aligned(self, spaced: list[str]) -> list[tuple | None]:
        """For each text (pairs, groups), or None where its tokens do not give its bytes back."""
        found: list[tuple | None] = [None] * len(spaced)
        a, b, same = self.encoded(spaced)
        use = [i for i, ok in enumerate(same) if ok]
        if not use:
            return found
        a_ids = np.concatenate([a[i] for i in use]).astype(np.int64)
        b_ids = np.fromiter(chain.from_iterable(map(b.__getitem__, use)), np.int64)
        a_lengths, b_lengths = self.a_lengths[a_ids], self.b_lengths[b_ids]
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        overlaps = list(product_blocks(token_bytes(a_lengths), token_bytes(b_lengths).transposed()))
        rows, columns = (np.concatenate([x[k] for x in overlaps]) for k in (0, 1))
        pairs = (a_ids[rows] * self.n_b + b_ids[columns]).astype(self.kind).tobytes()
        width = int(self.kind[2:])
        a_upto = np.cumsum(list(map(len, map(a.__getitem__, use))))
        links_upto = np.searchsorted(rows, a_upto)
        groups_upto = np.searchsorted(cuts, a_ends[a_upto - 1], "right")
        groups = self._groups(a_ids, b_ids, np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right"))
        link_at = group_at = 0
        for i, link_to, group_to in zip(use, (links_upto * width).tolist(), groups_upto.tolist()):
            found[i] = pairs[link_at:link_to], ";".join(groups[group_at:group_to]).encode()
            link_at, group_at = link_to, group_to
        return found

    @staticmethod
    def _groups(a_ids: np.ndarray, b_ids: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> list[str]:
        """The text of each group, `a1,a2|b1`; the cuts are one past each group's last token."""
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        starts = [0, *a_cut.tolist()], [0, *b_cut.tolist()]
        lone = (np.diff(a_cut, prepend=0) == 1) & (np.diff(b_cut, prepend=0) == 1)
        return [
            a_text[i] + "|" + b_text[k] if one else ",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m])
            for one, i, j, k, m in zip(lone.tolist(), starts[0], starts[0][1:], starts[1], starts[1][1:])
        ]

    def documents(self, texts: list[str]) -> list[tuple | None]:
        """For each whole text its pairs and groups, or None for those without tokens."""
        lists = [self.pieces(t) for t in texts]
        new = set(chain.from_iterable(lists)).difference(self.known)
        if self.size > CACHE_BYTES:
            self.known, self.older, self.size = {}, self.known, 0
            new = set(chain.from_iterable(lists))
        back = new.intersection(self.older)
        fresh = list(new - back)
        self.known.update(zip(back, map(self.older.__getitem__, back)))
        self.known.update(zip(fresh, self.aligned([" " + p for p in fresh])))
        self.size += PIECE_BYTES * len(new) + 8 * sum(map(len, new))
        of, out = self.known.__getitem__, []
        for text, pieces in zip(texts, lists):
            one = list(map(of, pieces))
            if not text:
                out.append(None)
            elif None in one:  # a piece is read otherwise: the whole text decides
                out.append(self.aligned([" " + text])[0])
            else:
                out.append((b"".join([x[0] for x in one]), b";".join([x[1] for x in one])))
        for piece in [p for p in fresh if len(p) > CACHE_LONGEST]:
            del self.known[piece]
        return out


def _counts(groups: bytes) -> tuple[int, int, int]:
    """Tokens of A, of B, and groups of a text, from the text of its groups."""
    signs = np.frombuffer(groups, np.uint8)
    signs = signs[(signs == 0x2C) | (signs >= 0x3B)]  # , ; |
    n_groups = int(np.count_nonzero(signs == 0x7C))
    in_b = np.cumsum(np.where(signs == 0x7C, 1, np.where(signs == 0x3B, -1, 0)))
    commas = signs == 0x2C
    behind = int(np.count_nonzero(commas & (in_b == 1)))
    return n_groups + int(np.count_nonzero(commas)) - behind, n_groups + behind, n_groups


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(others)}


_loaded: dict[tuple, Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One per worker process; another pair of vocabularies takes its place."""
    if (a_path, b_path) not in _loaded:
        _loaded.clear()
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


def _planes(numbers: np.ndarray) -> bytes:
    """Sorted numbers laid out byte by byte: their high bytes are runs then, which files compress."""
    numbers = np.sort(numbers)
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    width = int(kind[2:])
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _align(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    def rows(batches):
        both = _tokenizers(a_path, b_path)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for i, j in slices(texts, SLICE_BYTES):
                out = []
                with no_collection():
                    found = both.documents([t.decode() for t in texts[i:j]])
                for x in found:
                    if x is None:
                        out.append((0, 0, 0, 0, "", b""))
                    else:
                        pairs = np.frombuffer(x[0], both.kind)
                        out.append((*_counts(x[1]), len(pairs), hashlib.sha256(x[1]).hexdigest(), _planes(pairs)))
                yield batch(_ALIGNED, ids[i:j], *zip(*out))

    return worker_texts(docs, id_col, text_col).mapInArrow(
        rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
    )


def links(docs: DataFrame, a_path: str, b_path: str, shared_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per link of a token of A with one of B: doc_id, a_index, b_index, a_id, b_id, shared_bytes.

    Overlap links hold the bytes that both tokens cover. With `shared_groups` all
    tokens of A and B in one group are linked, which may be many where a group is
    long; shared_bytes is then 1. Rows leave in blocks of a product; nulls, empty
    texts, and those whose tokens do not give their bytes back have none.
    """

    def rows(batches):
        both = _tokenizers(a_path, b_path)
        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not raw:
                    continue
                (a_ids,), (b_ids,), (same,) = both.encoded([" " + raw.decode()])
                if not same:
                    continue
                a_ids, b_ids = a_ids.astype(np.int64), np.array(b_ids, np.int64)
                if shared_groups:
                    a_ends, b_ends = np.cumsum(both.a_lengths[a_ids]), np.cumsum(both.b_lengths[b_ids])
                    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
                    blocks = product_blocks(token_groups(a_ends, cuts), token_groups(b_ends, cuts).transposed())
                else:
                    blocks = product_blocks(token_bytes(both.a_lengths[a_ids]), token_bytes(both.b_lengths[b_ids]).transposed())
                for row, column, value in blocks:
                    yield batch(_LINKS, [doc] * len(row), row, column, a_ids[row], b_ids[column], value)

    return worker_texts(docs, id_col, text_col).mapInArrow(
        rows, "doc_id long, a_index long, b_index long, a_id long, b_id long, shared_bytes long"
    )


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of A and B cover every text, and how usual their links are in all texts.

    One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. Every text is encoded once; the table written then holds each
    document's links as sorted numbers. The links of a chunk of that table are counted
    where they lie, summed over all chunks, and come back as one dictionary per chunk
    (`chunks`): nothing of the size of the corpus or the vocabularies is broadcast.

    A text that is null or empty, or whose tokens do not give its bytes back (such as
    one with U+2581), has no tokens: zeros and the digest ''. Repeated rows and null
    ids come out as they go in, and repeated texts count each time; an empty table
    gives no rows; other columns are ignored. Runs jobs when called.
    """
    spark = docs.sparkSession
    both = Tokenizers(a_path, b_path)
    n_b, kind = both.n_b, both.kind
    aligned = _align(docs, a_path, b_path, id_col, text_col)
    folder = shared_folder(spark, "aligned")
    aligned.write.option("compression", "zstd").parquet(folder)
    rows, chunk = placed(spark.read.schema(aligned.schema).parquet(folder))

    def lots(batches):
        lot, size = [], 0

        def counted():
            pair, times = np.unique(np.concatenate(lot), return_counts=True)
            return batch(_PAIRS, np.full(len(pair), held), pair.astype(np.int64), times)

        held = None
        for b in batches:
            for name, part in parts(b):
                if lot and name != held:
                    yield counted()
                    lot, size = [], 0
                held = name
                for planes in part.column("pairs").to_pylist():
                    lot.append(_numbers(planes, kind))
                    size += len(lot[-1])
                    if size > COUNT_LINKS:
                        yield counted()
                        lot, size = [], 0
        if lot:
            yield counted()

    pairs = cut_lineage(rows.select(chunk, "pairs").mapInArrow(lots, "chunk long, pair long, times long"))
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("links")).withColumn("b_id", F.col("pair") % n_b)
    most = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    known = counts.join(most, "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    dictionary = write_dictionary(pairs.select("chunk", "pair").distinct().join(known, "pair"), "pairs")

    def loaded(table: pa.Table):
        pair = table.column("pair").to_numpy()
        order = np.argsort(pair)
        return pair[order], table.column("links").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]

    def judged(batches):
        names = Dictionaries(dictionary, loaded)
        for b in batches:
            for name, part in parts(b):
                found = []
                for planes in part.column("pairs").to_pylist():
                    if not planes:
                        found.append((0, 0))
                        continue
                    pair, number, best = names[name]
                    at = np.searchsorted(pair, _numbers(planes, kind))
                    found.append((int(best[at].sum()), int(number[at].sum())))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in _ALIGNED.names[:-1]), *(pa.array(x, pa.int64()) for x in zip(*found))],
                    names=[*_ALIGNED.names[:-1], "n_best", "count_sum"],
                )

    return rows.select("*", chunk).mapInArrow(
        judged,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long",
    )
