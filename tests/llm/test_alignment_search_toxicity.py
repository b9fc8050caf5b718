"""Token alignment, ranked search and toxicity against brute force, over a table of odd cases; and over empty ones."""

import bisect
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from odd_tables import odd_rows, table  # noqa: F401 - a fixture
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import alignment, ranking, toxicity
from runlens.llm.queries import id_crc

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def spans(parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends], ends))


def whole_text(encoders, text):
    """Ids and spans of both tokenizers on a whole text, or None where they do not give its bytes back."""
    a, b = encoders
    if not text:
        return None
    shown = {c: x for x, c in byte_letters().items()}
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts = [bytes(shown[c] for c in a.id_to_token(i)) for i in a_ids]
    b_parts = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
        return None
    return a_ids, b_ids, spans(a_parts), spans(b_parts)


def byte_letters():
    """The byte alphabet by its rule: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    out, n = {}, 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            out[x] = chr(x)
        else:
            out[x] = chr(256 + n)
            n += 1
    return out


def brute_links(found):
    a_ids, b_ids, a_spans, b_spans = found
    return [
        (i, j, a_ids[i], b_ids[j], min(q, s) - max(p, r))
        for i, (p, q) in enumerate(a_spans) for j, (r, s) in enumerate(b_spans) if max(p, r) < min(q, s)
    ]


def brute_groups(found):
    a_ids, b_ids, a_spans, b_spans = found
    cuts = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
    groups = [([], []) for _ in cuts]
    for side, (ids, parts) in enumerate(((a_ids, a_spans), (b_ids, b_spans))):
        for i, (t, (_, e)) in enumerate(zip(ids, parts)):
            groups[bisect.bisect_left(cuts, e)][side].append((i, t))
    return groups


HARD = [
    "▁a", "a▁ b", "tab\tand\n\n lines ", "  two  spaces  ", "<s> </s> <unk> <0x0A> <|endoftext|>", "日本語 テキスト",
    "\U0001d4b3 \U0010ffff ￿", "café café ﬁx", "\x00\x01 \x1c \x85 \xa0x", "don't we'll 'tis 3.14", "x" * 300, " ", "\n", "a ​ b", "aa  aa",
]


def short_rows(odd_rows):
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in odd_rows]
    return rows + [(1000 + i, t) for i, t in enumerate(HARD)]


def test_alignment(spark, odd_rows, encoders):
    rows = short_rows(odd_rows)
    got = alignment.align(table(spark, rows), A_PATH, B_PATH).collect()
    found = [whole_text(encoders, t) for _, t in rows]
    links = [brute_links(f) if f else [] for f in found]
    counts = collections.Counter((a, b) for some in links for _, _, a, b, _ in some)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = collections.Counter()
    for (i, _), f, some in zip(rows, found, links):
        if f is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        groups = brute_groups(f)
        text = ";".join(",".join(str(t) for _, t in g) + "|" + ",".join(str(t) for _, t in h) for g, h in groups)
        best = sum(counts[a, b] == most[b] for _, _, a, b, _ in some)
        total = sum(counts[a, b] for _, _, a, b, _ in some)
        want[i, len(f[0]), len(f[1]), len(groups), len(some), best, total, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got
    ) == want
    assert sum(f is None for f in found) > 3


def test_links_of_both_kinds(spark, odd_rows, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "PRODUCT_BLOCK", 50)
    rows = [(i, t) for i, (_, t) in enumerate(short_rows(odd_rows)) if t is None or len(t) < 400]
    overlap = alignment.links(table(spark, rows), A_PATH, B_PATH).collect()
    shared = alignment.links(table(spark, rows), A_PATH, B_PATH, shared_groups=True).collect()
    want, groups = set(), set()
    for i, t in rows:
        if (found := whole_text(encoders, t)) is not None:
            want |= {(i, *link) for link in brute_links(found)}
            groups |= {(i, p, q, s, u) for g, h in brute_groups(found) for p, s in g for q, u in h}
    assert {tuple(r) for r in overlap} == want and len(overlap) == len(want)
    assert {tuple(r)[:5] for r in shared} == groups and len(shared) == len(groups)
    assert {tuple(r)[:5] for r in overlap} <= groups


def test_product_of_sparse_matrices(monkeypatch):
    monkeypatch.setattr(alignment, "PRODUCT_BLOCK", 7)
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, k, m = rng.integers(1, 9, 3)
        dense = [(rng.random(shape) < 0.3) * rng.integers(1, 5, shape) for shape in ((n, k), (k, m))]
        a, b = (
            alignment.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(1))]), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense
        )
        out = np.zeros((n, m), int)
        for row, column, value in alignment.product_blocks(a, b):
            out[row, column] += value
        assert (out == dense[0] @ dense[1]).all()
        back = b.transposed()
        assert (back.rows, back.width) == (m, k) and (back.values[np.argsort(back.columns, kind="stable")] == b.values).all()


def test_pieces_are_read_as_in_their_text(encoders):
    rng = random.Random(3)
    letters = "ab eE'é中\n\t  .,-!1́ \xa0▁"
    both = alignment.Tokenizers(A_PATH, B_PATH)
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3000)]
    for text, found in zip(texts, both.documents(texts)):
        want = whole_text(encoders, text)
        assert (found is None) == (want is None)
        if want:
            pairs = sorted(np.frombuffer(found[0], both.kind).tolist())
            assert alignment._counts(found[1]) == (len(want[0]), len(want[1]), len(brute_groups(want)))
            assert pairs == sorted(a * both.n_b + b for _, _, a, b, _ in brute_links(want))


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_rank(docs, items, top=10):
    lists = [(i, terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(x) for _, x in lists), sum(len(x) for _, x in lists)
    df = collections.Counter(t for _, x in lists for t in set(x))
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i].update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, x in lists:
            tf = collections.Counter(x)
            m = 100 - 90 + (90 * len(x) * n_docs) // n_terms if n_terms else 0
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in terms if t in tf
            )
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        for r, (s, *_, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, r, doc, -s))
    return sorted(out, key=repr)


ITEMS = [
    (1, "One two"), (2, None), (3, ""), (4, " ... "), (5, "don't we'll it's"), (1, "tabs TWO one"), (6, "Ünïcode é Ünïcode"),
    (7, "nowhere"), (None, "lone text"), (8, "日本語 中文"), (9, "314 3 14 abc"), (10, "Σίσυφος ΟΔΟΣ"),
]


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_ranked_search(spark, odd_rows, monkeypatch, block):
    """One automaton for all items, and one for each item."""
    monkeypatch.setattr(ranking, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranking, "CANDIDATES", 5)
    words = " ".join(t for _, t in odd_rows[:2])
    items = [*ITEMS, (11, words)] if block > 1 else ITEMS[:6]
    got = ranking.rank(
        table(spark, odd_rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string"), top=4
    )
    want = brute_rank(odd_rows, items, 4)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == want
    assert len(want) > 7


def toxic_rows():
    """Prose with insults of its own, four in a toxic text, and none in the others."""
    rng = random.Random(11)
    stems = ["an", "er", "th", "on", "in", "es", "ti", "re", "nd", "st", "ou", "ea"]
    insults = ["grumbleface", "stinkwort", "dunderhead", "muckraker", "pigswill"]

    def prose(n):
        return ["".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n)]

    rows = []
    for i in range(500):
        words, toxic = prose(rng.randint(40, 160)), i % 4 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = table(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "Grumbleface"), (902, "x " * 60_000), (0, rows[0][1])])
    labels = spark.createDataFrame(
        [(i, y, 1) for i, _, y in rows] + [(i, 0, 1) for i, _, _ in rows[:20]] + [(None, 1, 1), (7777, 1, 1), (903, None, 1)],
        "doc_id long, toxic int, text int",
    )
    held = id_crc(3) == 1
    model = toxicity.train(docs, labels, ~held)
    got = toxicity.judge(docs, model).withColumn("held", held).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in rows}
    tested = [(r.predicted, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    caught = [p for p, y in tested if y]
    spared = [not p for p, y in tested if not y]
    assert len(caught) > 30 and sum(caught) >= 0.9 * len(caught) and sum(spared) >= 0.97 * len(spared)
    again = toxicity.train(docs, labels, ~held)
    assert (again.toxic, again.weights.tolist()) == (model.toxic, model.weights.tolist())
    assert {r.score for r in got if r.doc_id in (900, 901)} == {float(model.score(model.features("")))}
    assert len({r.score for r in got if r.doc_id == 0}) == 1  # a repeated row


def test_toxicity_savings_of_long_texts_equal_those_of_their_windows(monkeypatch):
    model = toxicity.Model(b"the quick brown fox jumps " * 40, b"some other words of no kind " * 9)
    text = toxicity.normalized("Some other words of the quick fox " * 900)
    whole = model.savings(text, 96, 64)
    monkeypatch.setattr(toxicity, "_AT_ONCE", 7)
    assert (model.savings(text, 96, 64) == whole).all()


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1, 1], [1, 0]])
def test_toxicity_from_few_rows(labels):
    model = toxicity.fit([(f"text number {i} of a few", y) for i, y in enumerate(labels)])
    score = float(model.score(model.features("text")))
    assert 0 <= score <= 1
    if len(set(labels)) == 1:
        assert round(score) == labels[0]


def test_empty_tables(spark):
    empty, items = table(spark, []), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert alignment.align(empty, A_PATH, B_PATH).count() == 0
    assert alignment.links(empty, A_PATH, B_PATH).count() == 0
    assert ranking.rank(empty, items).count() == 0
    assert ranking.rank(table(spark, [(1, "one")]), items.limit(0)).count() == 0
    assert ranking.rank(table(spark, [(1, None), (2, "..")]), items).columns == ["item_id", "rank", "doc_id", "score"]
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.judge(empty, model).count() == 0
    assert [r.predicted for r in toxicity.judge(table(spark, [(1, "a")]), model).collect()] == [0]
