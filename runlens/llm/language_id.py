"""Language identification: averaged hashed subword embeddings and a linear softmax, trained here."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from runlens.llm.shared import batch, worker_texts

#: Rows that training may take at most, a fifth of them for calibration; share of these that may lie under twice the limit
#: (six of 600: less, and the limits would hang on the one oddest row); how much more of its subwords than all but that
#: share of the rows a text may have that no training row holds.
SAMPLE_ROWS, REJECT_SHARE, UNKNOWN_TIMES = 3000, 0.01, 20
#: Bytes of the subwords, buckets of their hash, numbers of an embedding.
ORDERS, BUCKETS, DIM = (1, 2, 3, 4), 1 << 15, 16
STEPS, RATE, MINI_BATCH = 1000, 2.0, 32
UNKNOWN = "und"
_BLOCK = 1 << 16

_PREDICTIONS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def subwords(data: bytes, begin: int = 0) -> np.ndarray:
    """Buckets of all subwords that start in a block of `data`, lower-cased UTF-8."""
    block = np.frombuffer(data, np.uint8)[begin : begin + _BLOCK + ORDERS[-1] - 1].astype(np.uint32)
    own = min(len(block), _BLOCK)
    found, code = [], np.zeros(len(block), np.uint32)
    for n in range(1, ORDERS[-1] + 1):
        if len(block) < n:
            break
        code = (code[: len(block) - n + 1] << np.uint32(8)) | block[n - 1 :]
        salted = (code[:own] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        found.append(((salted ^ (salted >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(17))  # the top 15 bits
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.int64)
    for begin in range(0, len(data), _BLOCK):
        total += np.bincount(subwords(data, begin), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


@dataclass
class Model:
    """`table`: each bucket's share in the logits (embedding times weights); temperature and limits are calibrated.

    `known` marks the buckets that training rows fill; `unknown` is the share of a text's subwords that may lie outside.
    """

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0
    known: np.ndarray | None = None
    unknown: float = 1.0

    def chances(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def logits(self, text: str) -> np.ndarray:
        data = text.lower().encode()
        total, n = np.zeros(len(self.langs)), 0
        for begin in range(0, len(data), _BLOCK):
            at = subwords(data, begin)
            total += np.bincount(at, minlength=BUCKETS).astype(np.float32) @ self.table
            n += len(at)
        return total / max(1, n)

    def strange(self, text: str) -> float:
        """Share of the subwords that no training row holds."""
        if self.known is None:
            return 0.0
        data, missed, n = text.lower().encode(), 0, 0
        for begin in range(0, len(data), _BLOCK):
            at = subwords(data, begin)
            missed += int(np.count_nonzero(~self.known[at]))
            n += len(at)
        return missed / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its chance, and whether the text is rejected: no letter, a chance under the limit, or too many unknown subwords."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        chance = self.chances(self.logits(text))
        best = int(chance.argmax())
        odd = chance[best] < self.limit or self.strange(text) > self.unknown
        return self.langs[best], float(min(1.0, chance[best])), bool(odd)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Trains on (text, language) rows by stochastic gradient descent; deterministic.

    Every fifth row is held back: a temperature is chosen by its likelihood, and
    the limit is half the chance that all but a share REJECT_SHARE of its rows reach.
    The share of unknown subwords allowed is UNKNOWN_TIMES what all but that share stay under.
    """
    rows = [(t, g) for t, g in rows if any(map(str.isalpha, t))]
    langs = sorted({g for _, g in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    features = [_counts(t.lower().encode()) for t, _ in rows]
    truth = np.array([langs.index(g) for _, g in rows])
    rng = np.random.default_rng(42)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    train = order[len(rows) // 5 :]
    table = rng.normal(0, 1 / np.sqrt(DIM), (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = -(-STEPS * MINI_BATCH // len(train))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(train)
        for i in range(0, len(order), MINI_BATCH):
            docs = order[i : i + MINI_BATCH]
            at = np.concatenate([features[d][0] for d in docs])
            share = np.concatenate([features[d][1] for d in docs]).astype(np.float32)
            starts = np.cumsum([0, *(len(features[d][0]) for d in docs[:-1])])
            mean = np.add.reduceat(table[at] * share[:, None], starts)
            z = mean @ weights + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            slope = e / e.sum(axis=1, keepdims=True)
            slope[np.arange(len(docs)), truth[docs]] -= 1
            slope /= len(docs)
            back = slope @ weights.T
            weights -= rate * mean.T @ slope
            bias -= rate * slope.sum(axis=0)
            lengths = np.diff([*starts, len(at)])
            step = np.repeat(back, lengths, axis=0) * (share * rate * 8)[:, None]
            for d in range(DIM):
                table[:, d] -= np.bincount(at, weights=step[:, d], minlength=BUCKETS).astype(np.float32)
    known = np.zeros(BUCKETS, bool)
    for d in train:
        known[features[d][0]] = True
    model = Model(langs, (table @ weights).astype(np.float32), bias.astype(np.float64), known=known)
    if len(held):
        logits = np.array([model.logits(rows[d][0]) for d in held])

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.chances(logits)[np.arange(len(held)), truth[held]] + 1e-12).mean()

        model.temperature = min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
        model.limit = 0.5 * float(np.quantile(model.chances(logits).max(axis=1), REJECT_SHARE, method="lower"))
        strange = [model.strange(rows[d][0]) for d in held]
        model.unknown = UNKNOWN_TIMES * float(np.quantile(strange, 1 - REJECT_SHARE, method="higher"))
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most SAMPLE_ROWS labelled rows for which `usable` holds: those with the least hashes of their ids.

    The ids are ranked first, without the texts; then the chosen rows are read.
    """
    labelled = docs.filter(F.coalesce(usable, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.xxhash64(F.col(id_col))
    edge = labelled.select(place.alias("h")).orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if edge is None:
        return fit([])
    rows = labelled.filter(place <= edge).select(
        F.col(text_col).cast("string"), F.col(lang_col).cast("string"), place
    ).limit(SAMPLE_ROWS).collect()
    return fit([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], r[0]))])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, from its whole text alone.

    A text that is null or has no letter is `und` with score 0 and rejected, and
    so is every text if the model has learned no language. `rejected` also holds
    where the score is under the calibrated limit or too many subwords are unknown. Repeated rows and null ids come
    out as they go in; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages

    def judged(batches):
        for b in batches:
            found = [shared.value.predict(t.decode()) for t in b.column("text").to_pylist()]
            yield batch(_PREDICTIONS, b.column("doc_id"), *([f[i] for f in found] for i in range(3)))

    return worker_texts(docs, id_col, text_col).mapInArrow(
        judged, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def accept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text is not rejected, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.predict(t)[2] for t in texts], dtype=bool)

    return docs.filter(accepted(F.col(text_col)))
