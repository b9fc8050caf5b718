"""Texts as numbers of their distinct pieces, and what is known of the pieces laid end to end, a column at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A byte that no text in UTF-8 holds.
MARK = b"\xff"
#: Numbers that are laid at once, so that what is made of them stays small however long a text is.
_LAID = 1 << 16


def strings(column) -> list:
    """The column's values as Python strings (or bytes): `to_pylist` makes an Arrow scalar of each on the way."""
    return column.to_numpy(zero_copy_only=False).tolist()


def marked(texts: pa.Array, mark: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces between marks in a binary column of texts; the number of the piece at every place; where texts end there."""
    lists = pc.split_pattern(texts, mark)
    coded = lists.flatten().dictionary_encode()
    stops = lists.offsets.to_numpy().astype(np.int64)
    return strings(coded.dictionary.cast(pa.large_string())), coded.indices.to_numpy(), stops[1:] - stops[0]


class Parts:
    """Byte strings by number; each holds whole units of `width` bytes."""

    def __init__(self, parts: list[bytes], width: int = 1):
        self.units = np.frombuffer(b"".join(parts), f"<u{width}")
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // width
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.width = width

    def laid(self, numbers: np.ndarray, stops: np.ndarray) -> list[bytes]:
        """The strings of `numbers` end to end, cut where the numbers' places are `stops`."""
        data, ends = [], [np.zeros(1, np.int64)]
        for at in range(0, len(numbers), _LAID):
            some = numbers[at : at + _LAID]
            lengths = self.lengths[some]
            upto = np.cumsum(lengths)
            data.append(self.units[np.repeat(self.starts[some] - upto + lengths, lengths) + np.arange(upto[-1])].tobytes())
            ends.append(upto + ends[-1][-1])
        whole = b"".join(data)
        cuts = (np.concatenate(ends)[stops] * self.width).tolist()
        return [whole[i:j] for i, j in zip([0, *cuts], cuts)]
