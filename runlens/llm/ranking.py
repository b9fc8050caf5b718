"""Ranked lexical search: items scored against all documents by an Aho-Corasick scan of their texts.

No index of the documents is made. All terms of the items form one automaton, each
guarded by a boundary on both sides, which counts their occurrences in the text as
it lies. The first scan gives the corpus's counts, the second scores and keeps the
best documents of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.shared import batch, cut_lineage, worker_texts

#: What a term is: characters other than the ASCII ones that are no letters or digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms that one automaton holds, and so what a broadcast holds; more items are taken in further blocks.
BLOCK_BYTES = 1 << 20
#: Parts that each item's best rows are cut into before the last choice; candidates a task gathers before it thins them.
SPREAD, CANDIDATES = 32, 1 << 16

#: Every ASCII character outside of terms becomes a space, A-Z are lower-cased; bytes of other characters stay.
_PLAIN = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x > 0x7F else 0x20 for x in range(256)
)
_COUNTS = pa.schema([("term", pa.int32()), ("docs", pa.int64()), ("times", pa.int64())])
_BEST = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, terms: the distinct terms of each item, over all rows of its id."""
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    found = items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def blocks(terms: DataFrame) -> list[list]:
    """Values of `block` to take in turn, after `terms` was cut so that a block has BLOCK_BYTES of terms at most, or one item.

    Items are dealt by hash; the number of blocks is doubled until none is too large.
    """
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 2)
    sized = cut_lineage(terms.select(F.xxhash64("item_id").alias("place"), "item_id", "terms", size.alias("bytes")))
    n = 1
    while True:
        dealt = sized.withColumn("block", F.pmod("place", F.lit(n)))
        worst = dealt.groupBy("block").agg(F.sum("bytes").alias("b"), F.count_distinct("place").alias("k")).filter("k > 1").agg(F.max("b")).first()[0]
        if worst is None or worst <= BLOCK_BYTES:
            return [dealt.filter(F.col("block") == i) for i in range(n)]
        n *= 2


class Automaton:
    """The terms of a block of items with their automaton; goes to workers as it is."""

    def __init__(self, rows: list):
        import ahocorasick

        self.items = [r["item_id"] for r in rows]
        self.terms = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(self.terms)}
        held = [[number[t] for t in r["terms"]] for r in rows]
        self.of_items = np.array([t for x in held for t in x], np.int64)
        self.starts = np.cumsum([0, *map(len, held[:-1])])
        self.scan = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            self.scan.add_word(f" {t.encode().decode('latin-1')} ", i)  # bytes as characters
        self.scan.make_automaton()

    def count(self, text: bytes) -> tuple[int, dict[int, int]]:
        """How many terms a text has, and how often each of the block's."""
        plain = b" " + text.translate(_PLAIN) + b" "
        space = np.frombuffer(plain, np.uint8) == 0x20
        n = int(np.count_nonzero(space[:-1] & ~space[1:]))
        return n, Counter(map(itemgetter(1), self.scan.iter(plain.decode("latin-1"))))


def rank(
    docs: DataFrame, items: DataFrame, top: int = 10,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` documents with a score above 0, equal scores by ascending doc_id.

    Terms and scores are the contract's: integers, from weights floor(1000 ln ((2N + 2) / (2 df + 1))).
    Every row of `docs` is a document, so repeated rows rank each for itself; a null id
    stands before all others. Rows of `items` with one id are one item with the
    terms of all of them, each once; items and documents whose text is null, empty or
    without a term have no rows, nor has an empty table. Other columns are ignored.

    Each block of items scans the texts twice. The driver sees a block's terms and
    two numbers for each: at most BLOCK_BYTES of terms, unless a single item has more.
    Runs jobs when called.
    """
    spark = docs.sparkSession
    texts = worker_texts(docs.filter(F.col(text_col).isNotNull()), id_col, text_col)
    out = None
    for block in blocks(item_terms(items, item_id_col, item_text_col)):
        rows = sorted(block.select("item_id", "terms").collect(), key=lambda r: (r["item_id"] is not None, r["item_id"]))
        if not rows:
            continue
        automaton = Automaton(rows)
        shared = spark.sparkContext.broadcast(automaton)
        counts = _corpus_counts(texts, shared)
        totals = counts.pop(-1, (0, 0))
        if not totals[0]:
            continue
        weights = np.zeros(len(automaton.terms), np.int64)
        for term in range(len(weights)):
            weights[term] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * counts.get(term, (0, 0))[0] + 1)))
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {block.schema['item_id'].dataType.simpleString()}"
        )
        best = _best(texts, shared, weights, totals, top)
        order = (F.col("score").desc(), F.col("doc_id").asc())
        by_item = Window.partitionBy("item").orderBy(*order)
        by_part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).orderBy(*order)
        # thinned in parts first, so that no task gets all candidates of an item
        thin = best.withColumn("r", F.row_number().over(by_part)).filter(F.col("r") <= top)
        chosen = thin.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= top).join(names, "item")
        found = cut_lineage(chosen.select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.unionByName(found)
        shared.unpersist()
    if out is None:
        kind = items.schema[item_id_col].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def _corpus_counts(texts: DataFrame, shared) -> dict[int, tuple[int, int]]:
    """Documents and occurrences by term; under -1 all documents that have a term, and all terms."""

    def counted(batches):
        automaton = shared.value
        held = np.zeros(len(automaton.terms), np.int64)
        docs = terms = 0
        for b in batches:
            for text in b.column("text").to_pylist():
                n, times = automaton.count(text)
                docs += n > 0
                terms += n
                held[list(times)] += 1
        at = np.flatnonzero(held)
        yield batch(_COUNTS, [-1, *at.tolist()], [int(docs), *held[at].tolist()], [terms, *[0] * len(at)])

    sums = texts.mapInArrow(counted, "term int, docs long, times long").groupBy("term")
    return {r[0]: (r[1], r[2]) for r in sums.agg(F.sum("docs"), F.sum("times")).collect()}


def _best(texts: DataFrame, shared, weights: np.ndarray, totals: tuple[int, int], top: int) -> DataFrame:
    """item (its number), doc_id, score: for each task its `top` rows of each item."""
    all_docs, all_terms = totals

    def scored(batches):
        automaton = shared.value
        limit = np.zeros(len(automaton.items), np.int64)  # what a score must reach to matter
        kept, size = [], 0

        def thinned():
            item, doc, score = (np.concatenate(x) for x in zip(*kept))
            null = doc == -(1 << 63)
            order = np.lexsort((doc, ~null, -score, item))
            item, doc, score = item[order], doc[order], score[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            last = place == top - 1
            limit[item[last]] = score[last]
            keep = place < top
            return [(item[keep], doc[keep], score[keep])]

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n, times = automaton.count(text)
                if not times:
                    continue
                m = 100 - 90 + (90 * n * all_docs) // all_terms
                term = np.fromiter(times, np.int64, len(times))
                tf = np.fromiter(times.values(), np.int64, len(times))
                worth = np.zeros(len(automaton.terms), np.int64)
                worth[term] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                score = np.add.reduceat(worth[automaton.of_items], automaton.starts)
                item = np.flatnonzero((score > 0) & (score >= limit))
                if len(item):
                    kept.append((item, np.full(len(item), -(1 << 63) if doc is None else doc), score[item]))
                    size += len(item)
                    if size > CANDIDATES + len(automaton.items) * top:
                        kept = thinned()
                        size = len(kept[0][0])
        if kept:
            (item, doc, score), = thinned()
            yield batch(_BEST, item.astype(np.int32), pa.array(doc, pa.int64(), mask=doc == -(1 << 63)), score)

    return texts.mapInArrow(scored, "item int, doc_id long, score long")
