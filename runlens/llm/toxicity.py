"""Toxicity by compression distance: how many bytes a dictionary of toxic text saves in the windows of a text.

Two dictionaries are trained, one on ordinary, one on toxic text. The toxic one
is put before the ordinary one, so that a window that is ordinary compresses alike
by both, and what the toxic one saves comes from toxic wording alone. The savings of
a text's windows give a calibrated score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.shared import batch, worker_texts

#: Labelled rows of each kind that training may take at most, and bytes of the longest text among them.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2000, 4000, 1 << 14
#: Bytes of a window and from one to the next: when scoring, when looking for toxic windows, and for ordinary ones to match.
WINDOW, STEP, FINE, FINE_STEP, ORDINARY_STEP = 96, 64, 32, 12, 32
#: Bytes of the dictionaries; segment and match lengths of their trainer; rounds; ordinary windows that may save as much.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, MATCH, ROUNDS, QUANTILE = 250_000, 4096, 12, 6, 3, 0.998
LEVEL, THRESHOLD = 6, 0.7
_AT_ONCE = 1 << 15
FEATURES = 6

_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def normalized(text: str) -> bytes:
    """Lower-cased, white space as single spaces, one on each side."""
    return f" {' '.join(text.lower().split())} ".encode()


def windows(n: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows over n bytes; the last ones may be shorter."""
    starts = np.arange(0, max(1, n - (size - step)), step)
    return starts, np.minimum(size, n - starts)


def trained(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """A dictionary of `size` bytes at most; samples too few for the trainer are laid end to end instead."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=match).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Compressor:
    """Compressed lengths of windows with a dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        self.zstandard = zstandard
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=4, source_size=WINDOW, dict_size=len(dictionary), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        data = zstandard.ZstdCompressionDict(dictionary or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=parameters)
        self.by = zstandard.ZstdCompressor(compression_params=parameters, dict_data=data)

    def lengths(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        places = np.stack([starts, sizes], 1).astype("<u8").tobytes()
        out = self.by.multi_compress_to_buffer(self.zstandard.BufferWithSegments(data, places))
        return np.fromiter(map(len, out), np.int64, len(starts))


@dataclass
class Model:
    """The two dictionaries and the logistic regression on what the toxic one saves."""

    ordinary: bytes = b""
    toxic: bytes = b""
    middle: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    _by: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_by": None}  # compressors stay where they were made

    def savings(self, data: bytes, size: int, step: int) -> np.ndarray:
        """For each window: its compressed length by the ordinary dictionary less that by both."""
        if self._by is None:
            self._by = Compressor(self.ordinary), Compressor(self.toxic + self.ordinary)
        starts, sizes = windows(len(data), size, step)
        out = [
            self._by[0].lengths(data, starts[i : i + _AT_ONCE], sizes[i : i + _AT_ONCE])
            - self._by[1].lengths(data, starts[i : i + _AT_ONCE], sizes[i : i + _AT_ONCE])
            for i in range(0, len(starts), _AT_ONCE)
        ]
        return np.concatenate(out)

    def features(self, text: str) -> np.ndarray:
        """The three largest savings, their sum, the number of windows, the mean (the last three as logarithms)."""
        saved = np.maximum(self.savings(normalized(text), WINDOW, STEP), 0)
        top = np.sort(np.concatenate([saved, [0, 0, 0]]))[:-4:-1]
        total, n = np.log1p(saved.sum()), np.log(len(saved))
        return np.array([*top, total, n, total - n])

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.middle) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def calibrate(self, texts: list[str], labels: list[int]) -> None:
        """Logistic regression, by gradient descent, on the features of texts the dictionaries were not trained on."""
        x, y = np.array([self.features(t) for t in texts]), np.array(labels, float)
        self.middle, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.hstack([(x - self.middle) / self.scale, np.ones((len(x), 1))])
        self.weights = np.zeros(FEATURES + 1)
        for _ in range(3000):
            chance = 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))
            self.weights -= 0.3 * (x.T @ (chance - y) / len(y) + 1e-3 * self.weights)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Trains on (text, toxic) rows; deterministic.

    Two fifths of the ordinary texts make the ordinary dictionary. The toxic ones but
    a quarter fall into two halves; in each round the windows of one half that the
    dictionary of the other saves more in than it does in all but a share of
    ordinary windows make that half's next dictionary, so that what only one text
    holds drops out. The last round's windows of both halves make the toxic dictionary.
    Texts not used so far calibrate the score. Without rows of both kinds the score
    is 0 for every text, or 1 if all rows are toxic.
    """
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not ordinary:
        model = Model()
        model.weights[-1] = 500.0 if toxic else -500.0
        return model
    held = max(1, len(toxic) // 4)
    held_toxic, train_toxic = toxic[:held], toxic[held:] or toxic
    base, rest = ordinary[: -(-len(ordinary) * 2 // 5)], ordinary[-(-len(ordinary) * 2 // 5) :] or ordinary

    def cut(texts: list[bytes], size: int, step: int) -> list[bytes]:
        return [t[a : a + n] for t in texts for a, n in zip(*map(np.ndarray.tolist, windows(len(t), size, step)))]

    lines = [normalized(t) for t in base]
    common = trained(cut(lines, WINDOW, STEP), ORDINARY_BYTES, 64, MATCH)
    halves = [[normalized(t) for t in train_toxic[i::2] or train_toxic] for i in range(2)]
    plain = [normalized(t) for t in rest]
    samples = [cut(half, FINE, FINE_STEP) for half in halves]
    for _ in range(ROUNDS):
        models = [Model(common, trained(s, TOXIC_BYTES, SEGMENT, MATCH)) for s in samples]
        for i, half in enumerate(halves):
            other = models[1 - i]
            usual = np.concatenate([other.savings(t, FINE, ORDINARY_STEP) for t in plain])
            limit = max(1.0, np.quantile(usual, QUANTILE) + 1)
            found = []
            for t in half:
                starts, sizes = windows(len(t), FINE, FINE_STEP)
                for k in np.flatnonzero(other.savings(t, FINE, FINE_STEP) >= limit):
                    found.append(t[starts[k] : starts[k] + sizes[k]])
            samples[i] = found or samples[i]
    model = Model(common, trained(samples[0] + samples[1], TOXIC_BYTES, SEGMENT, MATCH))
    model.calibrate(held_toxic + rest, [1] * len(held_toxic) + [0] * len(rest))
    return model


def train(
    docs: DataFrame, labels: DataFrame, usable: Column,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fits on at most SAMPLE_TOXIC toxic and SAMPLE_ORDINARY other documents for which `usable` holds.

    `usable` is an expression over the id, taken in `labels`. Of the documents with a
    label and a text of 1 to SAMPLE_BYTES bytes those with the least hashes of their ids
    are taken; ids are ranked without the texts, then the chosen rows are read. A
    document with several labels is toxic if one says so; rows without label are not used.
    """
    spark = docs.sparkSession
    known = (
        labels.filter(F.coalesce(usable, F.lit(False)) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).alias("toxic")).filter(F.col("id").isNotNull())
    )
    size = F.octet_length(F.col(text_col).cast("string"))
    able = docs.filter(size.between(1, SAMPLE_BYTES)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    here = known.join(able.select("id"), "id", "left_semi").select("id", "toxic", F.xxhash64("id").alias("place"))
    chosen = []
    for kind, most in ((True, SAMPLE_TOXIC), (False, SAMPLE_ORDINARY)):
        chosen += here.filter(F.col("toxic") == kind).orderBy("place", "id").limit(most).collect()
    if not chosen:
        return fit([])
    wanted = spark.createDataFrame([(r["id"], r["toxic"], r["place"]) for r in chosen], "id long, toxic boolean, place long")
    rows = able.join(F.broadcast(wanted), "id").groupBy("id", "place", "toxic").agg(F.max("text").alias("text")).collect()
    return fit([(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: (r["place"], r["id"]))])


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row, from its whole text alone.

    A text that is null or empty is scored as one window without savings. Repeated
    rows and null ids come out as they go in; an empty table gives no rows; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def judged(batches):
        model = shared.value
        for b in batches:
            scores = [float(model.score(model.features(t.decode()))) for t in b.column("text").to_pylist()]
            yield batch(_SCORES, b.column("doc_id"), scores, [int(s >= THRESHOLD) for s in scores])

    return worker_texts(docs, id_col, text_col).mapInArrow(judged, "doc_id long, score double, predicted int")
