"""Encoding by the tokenizers library with a cache of what it gave for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runlens.llm.pieces import MARK, Parts, marked
from runlens.llm.shared import no_collection, release_memory, slices

#: Bytes of one generation of a worker's cache (it holds two), what a piece takes there beside its letters, and bytes of
#: text encoded at once.
CACHE_BYTES, PIECE_BYTES, SLICE_BYTES = 64 << 20, 230, 4 << 20
#: Signs that end a word wherever they follow a letter; an apostrophe does not. Words of a line.
_TAIL, LINE_WORDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 250
#: Characters that normalization maps one by one, whatever stands beside them: none of them composes with another.
_SIMPLE = "\\x00-\\u017f"
#: All white space (of str.isspace), and a space that touches some.
_SPACE = "\t\n\v\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = f" [{_SPACE}]|[{_SPACE}] "


class WordCache:
    """ids of whole texts, as little-endian numbers of `width` bytes.

    Both vocabularies of this kind cut a text between any character and white
    space that follows it, and between a letter or digit and a run of
    punctuation. So a text is cut at single spaces, and what the library gives
    for a piece is what it gives for that piece of the text. Where a space touches
    other white space the whole text goes through the library, and so does a text
    that holds the string of an added token.

    Where the vocabulary normalizes, a text is normalized once, as a whole and by the
    library, before it is cut; pieces are then encoded by a copy of it that does not
    normalize (doing so twice is not the same). Texts of simple characters alone are
    lower-cased here, which is all that is done to them.

    Pieces not seen before are encoded together: letters-only words are laid in
    one line, and the line's ids are parted where a word begins or ends. Such a
    line holds the signs that stand for bytes already and needs no search for
    words; it goes through the same model behind a pre-tokenizer that only cuts at
    spaces. A line break between other characters is a match of its own.
    """

    def __init__(self, path: str, spaces: bool, lower: bool):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        plain = given | {"normalizer": None, "post_processor": None, "added_tokens": []}
        self.pieced = Tokenizer.from_str(json.dumps(plain)) if given["normalizer"] else self.library

        def cutter(sign: str, behavior: str) -> Tokenizer:
            cut = {"type": "Split", "pattern": {"String": sign}, "behavior": behavior, "invert": False}
            return Tokenizer.from_str(json.dumps(plain | {"pre_tokenizer": cut}))

        self.plain = cutter("Ġ", "MergedWithNext") if spaces else cutter(" ", "Removed")
        self.bare = cutter("Ċ", "Isolated")
        # the signs that stand for the bytes of the words that are laid in lines: letters of _SIMPLE
        signs = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
        others = [i for i in range(256) if i not in set(signs)]
        self.signs = {i: chr(i) for i in signs} | {i: chr(256 + n) for n, i in enumerate(others)}
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.spaces, self.lower = spaces, lower
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.rare = re.compile(f"[^{_SIMPLE}]")
        self.added = [t["content"].lower() for t in given["added_tokens"]]
        # ids that end a word (where white space is dropped) or begin one with its space
        self.edge = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if spaces else token.endswith("</w>")
        self.line_break = self.library.token_to_id("Ċ")

    def _raw(self, texts: list[str]) -> list[bytes]:
        """ids of normalized pieces, by the library's own search for words."""
        found = self.pieced.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _whole(self, texts: list[str]) -> list[bytes]:
        """ids of texts as they were given."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _signs(self, words: list[str]) -> list[str]:
        return [w if w.isascii() else w.encode().decode("latin-1").translate(self.signs) for w in words]

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of letters-only words, each taken with a space before it where spaces count."""
        out: list[bytes] = []
        for at in range(0, len(words), LINE_WORDS):
            some = words[at : at + LINE_WORDS]
            line = "Ġ" + "Ġ".join(self._signs(some)) if self.spaces else " ".join(self._signs(some))
            ids = np.array(self.plain.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
            edges = np.flatnonzero(self.edge[ids]) + (0 if self.spaces else 1)
            cuts = [*edges.tolist(), len(ids)] if self.spaces else [0, *edges.tolist()]
            data, w = ids.astype(self.kind).tobytes(), self.width
            if len(cuts) == len(some) + 1:
                out += [data[i * w : j * w] for i, j in zip(cuts, cuts[1:])]
            else:  # a letter that the library does not take for one
                out += self._raw([" " + x for x in some] if self.spaces else some)
        return out

    def _bare(self, words: list[str]) -> list[bytes]:
        """ids of letters-only words without a space before them, where spaces count."""
        out: list[bytes] = []
        for at in range(0, len(words), LINE_WORDS):
            some = words[at : at + LINE_WORDS]
            ids = np.array(self.bare.encode_batch_fast(["Ċ".join(self._signs(some))], add_special_tokens=False)[0].ids, np.int64)
            breaks = np.flatnonzero(ids == self.line_break).tolist()
            data, w = ids.astype(self.kind).tobytes(), self.width
            if len(breaks) == len(some) - 1:
                out += [data[i * w : j * w] for i, j in zip([0, *(k + 1 for k in breaks)], [*breaks, len(ids)])]
            else:
                out += self._raw(some)
        return out

    def _learn(self, new: list[str]) -> None:
        lines = {}
        if self.spaces:
            for piece in new:
                if "\n" in piece:
                    core = piece.removeprefix(" ")
                    if core.split() == core.split("\n"):  # no other white space, and no two line breaks beside each other
                        lines[piece] = piece.split("\n")
        if lines:
            single = dict.fromkeys(p for p in new if p not in lines)
            single.update(dict.fromkeys(p for some in lines.values() for p in some))
            new = [p for p in (*single, "\n") if p not in self.pieces]
            self.size += PIECE_BYTES * len(lines)
        self.size += PIECE_BYTES * len(new) + sum(map(len, new))
        plain, bare, other, parts = {}, {}, {}, {}
        for piece in new:
            core = piece.rstrip(_TAIL)
            spaced = self.spaces and core[:1] == " "
            word = core[1:] if spaced else core
            if word.isalpha() and (word.isascii() or not self.rare.search(word)):
                kind = plain if spaced or not self.spaces else bare
                known = self.pieces.get(core)
                if known is None:
                    kind[word] = b""
                parts[piece] = kind, word, known, len(core)
            else:
                other[piece] = b""
        for found, encode in ((plain, self._words), (bare, self._bare), (other, self._raw)):
            found.update(zip(found, encode(list(found))))
        ends = {piece[n:] for piece, (*_, n) in parts.items()}
        ends = dict(zip(ends, self._raw(list(ends))))
        self.pieces.update(other)
        for piece, (kind, word, known, n) in parts.items():
            ids = kind[word] if known is None else known
            self.pieces[piece] = ids + ends[piece[n:]] if n < len(piece) else ids
        for piece, some in lines.items():
            self.pieces[piece] = self.pieces["\n"].join(map(self.pieces.__getitem__, some))

    def _normal(self, text: str) -> str:
        if not self.lower:
            return text
        simple = text.isascii() or not self.rare.search(text)
        return text.lower() if simple else self.library.normalizer.normalize_str(text)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, bytes, list[int]]:
        """Normalized texts with a mark between pieces, the mark, and which texts those are; the others go through the library whole."""
        own = [i for i, t in enumerate(texts) if not ("<" in t and any(token in t.lower() for token in self.added))]
        column = pa.array([self._normal(texts[i]) for i in own], pa.large_string())
        if not self.spaces:  # white space is dropped, wherever it stands
            return pc.replace_substring(column, "\n", " ").cast(pa.large_binary()), b" ", own
        odd = pc.match_substring_regex(column, _ODD)
        own = [i for i, x in zip(own, odd.to_pylist()) if not x]
        return pc.replace_substring(column.filter(pc.invert(odd)).cast(pa.large_binary()), b" ", MARK + b" "), MARK, own

    def encode(self, texts: list[str]) -> list[bytes]:
        with no_collection():
            return [ids for i, j in slices(texts, SLICE_BYTES) for ids in self._slice(texts[i:j])]

    def _slice(self, texts: list[str]) -> list[bytes]:
        column, mark, own = self._cut(texts)
        wanted, numbers, stops = marked(column, mark)
        if self.size > CACHE_BYTES:
            self.pieces, self.older, self.size = {}, self.pieces, 0
        new = []
        for piece in wanted:
            if piece not in self.pieces:
                if (known := self.older.get(piece)) is None:
                    new.append(piece)
                else:
                    self.pieces[piece] = known
                    self.size += PIECE_BYTES + len(piece)
        self._learn(new)
        out: list = [None] * len(texts)
        for i, ids in zip(own, Parts(list(map(self.pieces.__getitem__, wanted)), self.width).laid(numbers, stops)):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest])):
            out[i] = ids
        return out


_caches: dict[tuple, WordCache] = {}


def word_cache(path: str, spaces: bool, lower: bool) -> WordCache:
    """The cache of a worker process; it lives as long as the worker, or until another vocabulary is asked for."""
    key = (path, spaces, lower)
    if key not in _caches:
        _caches.clear()
        release_memory()
        _caches[key] = WordCache(path, spaces, lower)
    return _caches[key]
