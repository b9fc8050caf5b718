"""Every operator on documents against brute force, over a table of odd cases; and over an empty one."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from odd_tables import odd_rows, table  # noqa: F401 - a fixture
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from runlens.llm import bpe, exact_dedup, language_id, language_model, packing, simhash, suffix_dedup, token_files
from runlens.llm.chunks import Dictionaries, write_dictionary
from runlens.llm.pieces import MARK, Parts, marked
from runlens.llm.queries import historical, id_crc, piece_digests
from runlens.llm.shared import keep_rows, shared_folder
from runlens.llm.word_cache import WordCache


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(spark, odd_rows):
    docs = table(spark, odd_rows)
    got = exact_dedup.dedup(docs, historical())
    groups = collections.defaultdict(list)
    for i, t in odd_rows:
        groups[hashlib.sha256(lowered(t).encode()).hexdigest()].append(i)
    want = [
        (i, max((x for x in groups[h] if x is not None), default=None), len(groups[h]), h)
        for i, t in odd_rows for h in [hashlib.sha256(lowered(t).encode()).hexdigest()]
    ]
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = got.filter("kept").collect()
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    left = keep_rows(docs, got.filter("kept"))
    assert left.count() == len(groups) and left.columns == docs.columns


def test_exact_dedup_with_another_split_gives_the_same(spark, odd_rows):
    docs = table(spark, odd_rows)
    columns = ("doc_id", "keep_id", "group_size", "text_sha256")
    all_new = exact_dedup.dedup(docs, id_crc(1) < 0)
    all_old = exact_dedup.dedup(docs, id_crc(1) == 0)
    assert tuples(all_new, *columns) == tuples(all_old, *columns)
    assert {r.known for r in all_new.collect()} == {False} and {r.known for r in all_old.collect()} == {True}


def test_perfect_hash():
    words = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(5000)), "<u8").reshape(-1, 4)
    hashed = exact_dedup.PerfectHash.load(exact_dedup.PerfectHash.build(words).dump())
    assert sorted(hashed.slots(words).tolist()) == list(range(5000))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd_rows):
    got = simhash.near_duplicates(table(spark, odd_rows))
    fps = [brute_fingerprint(t) for _, t in odd_rows]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((odd_rows[k][0] for k in range(len(fps)) if group[k] == g and odd_rows[k][0] is not None), default=None) for g in group}
    want = [(odd_rows[k][0], fps[k] - (1 << 64) * (fps[k] >> 63), least[group[k]]) for k in range(len(fps))]
    assert tuples(got, "doc_id", "fp", "component_id") == sorted(want, key=repr)
    docs = table(spark, odd_rows)
    assert keep_rows(docs, got.filter("kept")).count() == len(set(group))


def test_simhash_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {0, 2**64 - 1, 1, 3, 7}
    for s in seeds.tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 4), replace=False).tolist()
            fps.add(s ^ sum(1 << b for b in flips))
    fps = sorted(f - (1 << 64) * (f >> 63) for f in fps)
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & 2**64 - 1).bit_count() <= 2]
    assert tuples(got, "a", "b") == sorted(want, key=repr) and len(want) > 200


def test_token_files(spark, odd_rows):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder = shared_folder(spark, "tokens")
    manifest = token_files.write_tokens(table(spark, odd_rows), path, 2, folder)
    got = token_files.read_spans(manifest).collect()
    at, want = 0, []
    texts = collections.defaultdict(list)
    for i, t in odd_rows:
        texts[i].append(t or "")
    rows = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    crcs = collections.Counter()
    for i, t in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        crcs[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        want.append((r.doc_id, r.n_tokens, r.ids_crc32))
    assert collections.Counter(want) == crcs
    for r in manifest.collect():
        file = token_files.SequenceFile(r.path)
        flat = np.concatenate([ids for _, _, ids in file.documents()])
        for k in (0, (len(flat) - 1) // token_files.SEQUENCE):
            ids, mask = file.sequence(k)
            part = flat[k * token_files.SEQUENCE : (k + 1) * token_files.SEQUENCE]
            assert len(ids) == token_files.SEQUENCE and (ids[: len(part)] == part).all()
            assert mask.to_pylist() == [True] * len(part) + [False] * (len(ids) - len(part))


def test_packing(spark, odd_rows):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(table(spark, odd_rows), path, 1).collect()
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in odd_rows)
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 2 * r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    unique = {i for i, n in collections.Counter(i for i, _ in odd_rows).items() if n == 1}
    for i in unique:
        own = sorted((r.start, bytes(r.ids)) for r in pieces if r.doc_id == i)
        ids = tuple(np.frombuffer(b"".join(x for _, x in own), "<u2").tolist())
        assert (i, ids) in want and [s for s, _ in own] == np.cumsum([0, *(len(x) // 2 for _, x in own)]).tolist()[:-1]
    assert sum(r.length for r in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = sum(packing.SEQUENCE - n for p in sequences.values() if (n := sum(x for _, x in p)) & (n - 1))
    assert padding <= 0.02 * sum(r.length for r in pieces)
    assert piece_digests(spark.createDataFrame(pieces)).count() == len(pieces)


def test_cutting_stock_stays_within_the_demand():
    rng = np.random.default_rng(5)
    for n in (1, 30, 4000):
        sizes, counts = np.unique(rng.integers(1, 128, n), return_counts=True)
        demand = dict(zip(sizes.tolist(), counts.tolist()))
        used = collections.Counter()
        patterns = packing.solve(demand)
        for pattern, times in patterns:
            assert sum(k * c for k, c in pattern.items()) <= packing.CAPACITY
            for k, c in pattern.items():
                used[k] += c * times
        assert all(used[k] <= demand[k] for k in used)
        if n == 4000:
            least = sum(k * c for k, c in demand.items()) / packing.CAPACITY
            assert sum(t for _, t in patterns) <= 1.02 * least and sum(used.values()) > 0.9 * n
    assert packing.solve({}) == []


def test_bpe(spark, odd_rows):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(table(spark, odd_rows), path, P.PATTERN)
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in odd_rows]
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_long_match_merges_like_the_library():
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("the" * 100, "abcabcabd" * 50, "aaaaaaaab" * 40):
        assert [ranks[p] for p in bpe.merge_long(text.encode(), ranks)] == library.encode_ordinary(text)


def brute_cut(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(t)) if mark[p] and not (p and mark[p - 1]))
        yield sum(mark), spans, bytes(c for c, m in zip(t, mark) if not m)


def test_suffix_dedup(spark, odd_rows):
    texts = [(t or "").encode() for _, t in odd_rows]
    got = suffix_dedup.remove_repeats(table(spark, odd_rows))
    want = [(i, len(t), *found) for (i, _), t, found in zip(odd_rows, texts, brute_cut(texts, suffix_dedup.LENGTH))]
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 5000
    short = suffix_dedup.shorten(table(spark, odd_rows))
    assert tuples(short, "doc_id", "text") == sorted(
        ((i, None if t is None else w[4].decode(errors="ignore")) for (i, t), w in zip(odd_rows, want)), key=repr
    )


def test_suffix_dedup_of_a_crowd(spark, monkeypatch):
    """One passage in many texts, cut anywhere: the window path and the sorted path agree with brute force."""
    rng = np.random.default_rng(11)
    text = lambda n: bytes(rng.integers(97, 107, n).astype(np.uint8)).decode()
    passage = text(700)
    rows = []
    for i in range(60):
        a, b = sorted(rng.integers(0, 700, 2).tolist())
        rows.append((i, text(200) + passage[a : max(b, a + 420)] + text(150)))
    want = [(i, *found) for (i, _), found in zip(rows, brute_cut([t.encode() for _, t in rows], suffix_dedup.LENGTH))]
    for crowd in (512, 3):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        got = suffix_dedup.remove_repeats(table(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


def test_suffix_dedup_of_shorter_strings(spark, monkeypatch):
    """A length of its own, by both paths; passages of over 50 words but under 400 bytes go out of the pipeline's texts."""
    rng = np.random.default_rng(12)
    text = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 4))) for _ in range(n))
    passage = text(55)
    assert len(passage) < suffix_dedup.LENGTH
    rows = [(i, f"{text(20)} {passage[: 274 - 15 * (i % 5)]} {text(9)}") for i in range(12)] + [(12, text(300))]
    want = [(i, *found) for (i, _), found in zip(rows, brute_cut([t.encode() for _, t in rows], 100))]
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    got = suffix_dedup.remove_repeats(table(spark, rows), length=100).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    monkeypatch.undo()
    cut = dict(tuples(corpus_pipeline.cut_repeats(spark, table(spark, rows), ""), "doc_id", "text"))
    assert not any(passage[:194] in t for t in cut.values()) and cut[12] == rows[12][1]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(table(spark, rows), length=suffix_dedup.ANCHOR - 1)


def test_deep_shallow_sort():
    rng = np.random.default_rng(2)
    stem = bytes(rng.integers(97, 100, 90).astype(np.uint8))
    strings = [stem[: rng.integers(0, 90)] + bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(300)]
    strings += [stem, stem, b"", b"\0", b"\0\0"]
    order, shared = suffix_dedup.sort_strings(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)
    assert shared == [suffix_dedup.common(strings[i], strings[j]) for i, j in zip(order, order[1:])]


def test_language_model(spark, odd_rows):
    for budget in (language_model.BROADCAST_BYTES, 2000):  # one pass, and many
        rows = language_model.score(table(spark, odd_rows), id_crc(5) != 1, budget=budget)
        got = sorted((tuple(r) for r in rows.drop("score").collect()), key=repr)
        training = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in odd_rows]
        tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", lowered(t).encode()), None] for _, t in odd_rows]
        counts = collections.Counter(w for own, t in zip(tokens, training) if t for w in own)
        n, v = sum(counts.values()), len(counts)
        want = [
            (i, t, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
            for (i, _), own, t in zip(odd_rows, tokens, training)
        ]
        assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
        assert np.allclose([g[5] for g in got], [w[5] for w in sorted(want, key=repr)])
        scores = sorted(((r.doc_id or 0, r.n_tokens, r.score) for r in rows.collect()))
        if budget == language_model.BROADCAST_BYTES:
            first = scores
    assert np.allclose([s[2] for s in scores], [s[2] for s in first])


def test_filter_never_forgets(spark):
    keys = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 4000) % 9 + 1
    assert language_model.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    shards = language_model.LEAST_SHARDS
    shard = (keys >> np.uint64(64 - (shards.bit_length() - 1))).astype(int)
    blobs = [(int(s), language_model._blob(keys[shard == s], counts[shard == s])) for s in np.unique(shard)]
    table_ = language_model.build_filter(spark.createDataFrame(blobs, "shard int, blob binary")).collect()
    probe = language_model.Filter(shards, {r.shard: r.bits for r in table_})
    assert (probe.levels(keys) >= language_model.levels(counts)).all()


def test_successors_of_a_history_share_one_at_most():
    rng = np.random.default_rng(5)
    for _ in range(200):
        counts = rng.integers(1, 40, rng.integers(1, 60))
        assert language_model.least_counts(language_model.levels(counts)).sum() <= counts.sum()
    assert language_model.least_counts(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2, 4]


def test_language_id_of_odd_texts(spark, odd_rows):
    rows = [(*r, None) for r in odd_rows]
    none = language_id.identify(table(spark, rows), language_id.train(table(spark, rows), id_crc(1) == 0))
    assert {(r.lang_pred, r.score, r.rejected) for r in none.collect()} == {("und", 0.0, True)}
    model = language_id.fit([(t, "en") for _, t in odd_rows if t] + [("日本語 テキスト 中文", "ja")] * 5)
    got = language_id.identify(table(spark, odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    for i in (100, 101, 102, 115):
        assert [r.lang_pred for r in got if r.doc_id == i] == ["und"]
    accepted = language_id.accept(table(spark, odd_rows), model)
    assert accepted.count() == sum(not r.rejected for r in got)


def test_language_id_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(docs, id_crc(4) != 2)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(id_crc(4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and len(got) > 30


def test_empty_tables(spark):
    docs = table(spark, [])
    assert exact_dedup.dedup(docs, historical()).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert token_files.token_spans(docs, P.path("word_bpe_49k.json"), 2).count() == 0
    assert packing.pack(docs, P.path("byte_bpe_50k.json"), 1).count() == 0
    assert bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert language_model.score(docs, id_crc(5) != 1).count() == 0
    assert language_id.identify(docs, language_id.train(docs, id_crc(4) != 2)).count() == 0


def test_suffix_dedup_when_splits_change_between_scans(spark, tmp_path):
    """The texts are read once more when the result is; by then the cores, and so the splits, may be others."""
    rng = np.random.default_rng(17)
    text = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = text(600)
    rows = [(i, text(2000) + (passage if i % 5 == 0 else "")) for i in range(500)]
    path = str(tmp_path / "documents.parquet")
    writer = table(spark, rows).coalesce(1).write.option("parquet.block.size", 1 << 16).option("compression", "none")
    writer.option("parquet.page.size.row.check.min", 10).option("parquet.block.size.row.check.min", 10).parquet(path)
    want = sorted((i, *found) for (i, _), found in zip(rows, brute_cut([t.encode() for _, t in rows], suffix_dedup.LENGTH)))
    size = "spark.sql.files.maxPartitionBytes"
    try:
        for first, then in (("64m", "128k"), ("128k", "64m")):
            spark.conf.set(size, first)
            docs = spark.read.parquet(path)
            got, short = suffix_dedup.remove_repeats(docs), suffix_dedup.shorten(docs)
            spark.conf.set(size, then)
            assert sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want
            assert tuples(short, "doc_id", "text") == sorted(((w[0], w[3].decode()) for w in want), key=repr)
    finally:
        spark.conf.unset(size)


def test_dictionaries_when_splits_change_between_scans(spark, tmp_path, monkeypatch):
    """What was learned by one scan serves the next, whatever its splits."""
    monkeypatch.setattr("runlens.llm.chunks.CHUNK_ROWS", 50)
    rng = np.random.default_rng(19)
    words = np.array([f"w{i}" for i in range(900)])
    rows = [(i, " ".join(words[rng.integers(0, 900, 300)])) for i in range(400)]
    path = str(tmp_path / "documents.parquet")
    writer = table(spark, rows).coalesce(1).write.option("parquet.block.size", 1 << 16).option("compression", "none")
    writer.option("parquet.page.size.row.check.min", 10).option("parquet.block.size.row.check.min", 10).parquet(path)
    size, ranks = "spark.sql.files.maxPartitionBytes", P.path("byte_bpe_50k.tiktoken")
    found = []
    try:
        for first, then in (("64m", "128k"), ("128k", "64m")):
            spark.conf.set(size, first)
            docs = spark.read.parquet(path)
            ids = bpe.encode(docs, ranks, P.PATTERN, digests=True)
            scores = language_model.score(docs, id_crc(5) != 1, budget=100_000)  # several passes
            spark.conf.set(size, then)
            found.append((tuples(ids, "doc_id", "ids_sha256"), [(r.doc_id, r.n_tokens, round(r.score, 6)) for r in scores.orderBy("doc_id").collect()]))
    finally:
        spark.conf.unset(size)
    assert found[0] == found[1] and len(found[0][0]) == len(found[0][1]) == 400


def test_rows_behind_an_aggregate_are_dealt_to_chunks(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    table(spark, [(i, f"text {i}") for i in range(40)]).repartition(4).write.parquet(path)
    docs = spark.read.parquet(path).groupBy("doc_id").agg(F.max("text").alias("text"))
    got = language_model.score(docs, id_crc(5) != 1)
    assert got.count() == 40 and {r.n_tokens for r in got.collect()} == {3}


def test_words_are_read_as_by_the_library():
    """Random strings over alphabets that normalization, lower case and word patterns treat in ways of their own."""
    rng = random.Random(8)
    alphabets = [
        "abcdefgHTWYJzIİıſŉ", "éÉüÜßñçÀ", "\u095c\u0921\u093c\u0915\u0916\u093e\u094d", "\ufb2a\u05e9\u05c1\u05d0", "Σσςαάϊ\u03aa",
        "\u0327\u0301\u030c\u0307\u0308", "0129²½", " .,!?;:'-_\"<>|", "\n\t  \u0085\u001c\u00a0\u200b", "日本語ガ", "\U0001d4b3😀", "<|endoftext|>",
    ]

    def text():
        some = rng.sample(alphabets, rng.randint(1, 4)) + [" abc"]
        return "".join(
            rng.choice(rng.choice(some)) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "'s", "'LL", " the ", "<|STARTOFTEXT|>"])
            for _ in range(rng.randint(1, 24))
        )

    for name, spaces, lower in (("word_bpe_49k.json", False, True), ("byte_bpe_50k.json", True, False)):
        library, cache = Tokenizer.from_file(P.path(name)), WordCache(P.path(name), spaces, lower)
        texts = ["सड़क".replace("\u0921\u093c", "\u095c"), "J\u030c", "a <|endoftext|> b", *(text() for _ in range(20_000))]
        for at in range(0, len(texts), 500):
            some = texts[at : at + 500]
            want = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
            assert [np.frombuffer(x, cache.kind).tolist() for x in cache.encode(some)] == want


def test_sequences_lie_at_computed_places(spark):
    writer_folder = shared_folder(spark, "sequences")
    rows = [(i, " ".join(f"w{(i * 31 + k) % 977}" for k in range(3000))) for i in range(150)]
    path = P.path("word_bpe_49k.json")
    manifest = token_files.write_tokens(table(spark, rows).coalesce(1), path, 2, writer_folder)
    for r in manifest.collect():
        file = token_files.SequenceFile(r.path)
        sizes = [file.file.get_batch(k).num_rows for k in range(file.file.num_record_batches)]
        assert all(n == token_files.BATCH_SEQUENCES for n in sizes[:-1])
        flat = np.concatenate([ids for _, _, ids in file.documents()])
        for i in (0, 1, sum(sizes) // 2, sum(sizes) - 1):
            part = flat[i * token_files.SEQUENCE : (i + 1) * token_files.SEQUENCE]
            assert (file.sequence(i)[0][: len(part)] == part).all()
    assert sum(r.n_tokens for r in manifest.collect()) > token_files.SEQUENCE * token_files.BATCH_SEQUENCES


def test_suffix_dedup_has_a_dictionary_for_every_chunk(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    table(spark, [(1, "short"), (2, None)]).repartition(2).write.parquet(path)
    rows, folder = suffix_dedup._prepared(spark.read.parquet(path), "doc_id", "text")
    chunks = {r.chunk for r in rows.select("chunk").collect()}
    found = Dictionaries(folder, lambda t: suffix_dedup._by_row(t, ("begin", "stop")))
    assert len(chunks) == 2 and all(found[c] == {} for c in chunks)


def test_language_model_against_exact_bigram_counts(spark):
    """Few unseen bigrams get a count, few seen ones too high a level, and scores are close to those of exact counts."""
    rng = np.random.default_rng(23)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = [(i, " ".join(words[(3000 * rng.random(300) ** 2).astype(int)])) for i in range(600)]
    training = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    tokens = [["<s>", *t.split(), "</s>"] for _, t in rows]
    learned = [x for own, t in zip(tokens, training) if t for x in zip(own, own[1:])]
    seen, counts = collections.Counter(learned), collections.Counter(b for _, b in learned)
    counts["<s>"] = sum(training)
    n = len(learned)
    below = n + 0.5 * (len(counts) - 1 + 1)  # all but the start mark, and one for what is new

    def exact(own):
        total = 0.0
        for a, b in zip(own, own[1:]):
            history, unigram = counts[a], (counts[b] + 0.5) / below
            level = int(math.log2(seen[a, b])) + 1 if seen[a, b] else 0
            count = min(2.0 ** (level - 1) if level else 0.0, history)
            weight = language_model.WEIGHT * history / (history + language_model.HALF)
            total += math.log10(weight * count / max(history, 1) + (1 - weight) * unigram)
        return total

    got = {r.doc_id: r.score for r in language_model.score(table(spark, rows), id_crc(5) != 1).collect()}
    for kind in (True, False):
        some = [(got[i], exact(own), len(own) - 1) for (i, _), own, t in zip(rows, tokens, training) if t == kind]
        over = sum(g - w for g, w, _ in some) / sum(k for *_, k in some)
        print("log10 a token over exact counts,", "training" if kind else "held out", over)
        assert all(g > w - 1e-6 for g, w, _ in some) and over < (0.006 if kind else 0.015)

    code = {w: language_model._codes([w.encode()])[0] for w in words.tolist()}
    mixed = lambda a, b: language_model.mix(language_model.mix(np.array(a, np.uint64)) + np.array(b, np.uint64))
    pairs = sorted(x for x in seen if x[0] != "<s>" and x[1] != "</s>")
    draw = rng.integers(0, 3000, (60_000, 2))
    unseen = [(a, b) for a, b in words[draw].tolist() if (a, b) not in seen]
    docs = table(spark, rows).select("doc_id", F.col("text").cast("binary").alias("text"), (id_crc(5) != 1).alias("more_0"))
    shards = language_model.LEAST_SHARDS
    table_ = language_model.build_filter(language_model.bigram_blobs(docs, shards)).collect()
    probe = language_model.Filter(shards, {r.shard: r.bits for r in table_})
    found = probe.levels(mixed([code[a] for a, _ in unseen], [code[b] for _, b in unseen]))
    print("unseen with a count", (found > 0).mean())
    assert (found > 0).mean() < 0.013
    found = probe.levels(mixed([code[a] for a, _ in pairs], [code[b] for _, b in pairs]))
    level = language_model.levels(np.array([seen[x] for x in pairs]))
    print("seen with too high a level", (found > level).mean())
    assert (found >= level).all() and (found > level).mean() < 0.013


def test_language_model_reads_the_texts_as_often_for_a_large_filter(spark, monkeypatch):
    """Texts are not scored once more for every part of the filter, and the answers are those of the whole filter."""
    monkeypatch.setattr("runlens.llm.chunks.CHUNK_ROWS", 8)
    monkeypatch.setattr(language_model, "GATHER", 3000)
    rng = np.random.default_rng(31)
    words = np.array([f"w{i}" for i in range(2000)])
    lengths = [*rng.integers(0, 300, 60), 2500, 3500, 9000, 25_000, 0, 1]
    rows = [(i, " ".join(words[(2000 * rng.random(n) ** 2).astype(int)])) for i, n in enumerate(lengths)]
    docs, code = table(spark, rows), dict(zip(words.tolist(), language_model._codes([w.encode() for w in words.tolist()])))
    for training in (id_crc(5) != 1, F.col("doc_id") == 7, F.col("doc_id") < 0):
        learned = {r.doc_id for r in docs.filter(training).collect()}
        blobs = language_model.bigram_blobs(
            docs.select("doc_id", F.col("text").cast("binary").alias("text"), training.alias("more_0")), language_model.LEAST_SHARDS
        )
        probe = language_model.Filter(language_model.LEAST_SHARDS, {r.shard: r.bits for r in language_model.build_filter(blobs).collect()})
        counts = collections.Counter(w for i, t in rows if i in learned for w in [*t.split(), "</s>"])
        counts["<s>"] = len(learned)
        n = sum(counts.values()) - len(learned)
        below = n + 0.5 * (sum(c > 0 for w, c in counts.items() if w != "<s>") + 1)
        want = {}
        for i, t in rows:
            own = t.split()
            keys = language_model._pairs(np.array([code[w] for w in own], np.uint64), np.array([len(own)]))
            history = np.array([counts[w] for w in ["<s>", *own]])
            seen = np.minimum(language_model.least_counts(probe.levels(keys)), history)
            weight = language_model.WEIGHT * history / (history + language_model.HALF)
            unigram = (np.array([counts[w] for w in [*own, "</s>"]]) + 0.5) / below
            want[i] = np.log10(weight * seen / np.maximum(history, 1) + (1 - weight) * unigram).sum()
        for some in (docs, docs.orderBy(F.xxhash64("doc_id")), docs.repartition(3)):
            got = language_model.score(some, training, budget=2000)
            plan = got._jdf.queryExecution().toString()
            assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
            found = {r.doc_id: r.score for r in got.collect()}
            assert len(found) == len(rows) and np.allclose([found[i] for i in want], list(want.values()), rtol=1e-12)


def test_answers_of_the_filter(spark, monkeypatch):
    """Bigrams that agree in the bits of a short name, spans in several blobs, and shards that have learned nothing."""
    monkeypatch.setattr(language_model, "SHARD_BIGRAMS", 50)
    rng, shards = np.random.default_rng(37), language_model.LEAST_SHARDS
    keys = rng.integers(0, 1 << 64, 2000, np.uint64) >> np.uint64(8) | np.uint64(3 << 56)  # all of one shard
    plain, keys = keys[:40], np.unique(np.concatenate([keys, keys[:300] ^ np.uint64(5)]))  # that agree but in the lowest bits
    far = rng.integers(0, 1 << 64, 400, np.uint64) >> np.uint64(8) | np.uint64(9 << 56)
    learned, others, blobs = [], [], []
    for span in range(6):
        for _ in range(2):
            some = np.sort(rng.choice(keys[:1500] if span else plain, 200 if span else 20, replace=False))
            learned.append((span, some, rng.integers(1, 9, len(some))))
            some = np.sort(rng.choice(keys, 200, replace=False))
            others += [(3, span, some), (9, span, np.sort(far))]
    blobs += [(span, 3, True, language_model._blob(some, counts)) for span, some, counts in learned]
    blobs += [(span, shard, False, language_model._blob(some, np.zeros(len(some), int))) for shard, span, some in others]
    frame = spark.createDataFrame(blobs, "span long, shard int, learned boolean, blob binary").repartition(3)
    bits = {r.shard: r.bits for r in language_model.build_filter(frame).collect()}
    assert set(bits) == {3, 9} and bits[9] == b""
    probe = language_model.Filter(shards, bits)
    assert len(np.unique(probe.levels(keys))) > 3 and not probe.levels(far).any()
    told = language_model.filter_levels(frame, shards)
    assert {(r.learned, r.whole) for r in told.collect()} == {(a, b) for a in (True, False) for b in (True, False)}
    answers = language_model.Answers(write_dictionary(told, "answers"), shards, 1000)
    for kind, some in [(True, x[:2]) for x in learned] + [(False, x[1:]) for x in others]:
        span, own = some
        own = rng.permutation(own)
        assert (answers.levels(span, kind, own) == probe.levels(own)).all()
    with pytest.raises(KeyError):
        answers.levels(99, True, keys)


def test_language_id_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.train(docs, id_crc(4) != 2)
    held_out = [r.text for r in docs.filter(id_crc(4) == 2).select("text").collect() if r.text and any(map(str.isalpha, r.text))]
    rng = np.random.default_rng(29)

    def rejected(texts):
        return sum(model.predict(t)[2] for t in texts) / len(texts)

    def made(letters):
        return ["".join(rng.choice(list(letters + "  "), n)) for n in (30, 100, 400) for _ in range(40)]

    greek, cyrillic = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    cjk, junk = "".join(map(chr, range(0x4E00, 0x5E00))), "#$%&*@!{}[]();=+-/<>ax"
    kinds = {"greek": greek, "cyrillic": cyrillic, "cjk": cjk, "junk": junk, "hex": "0123456789abcdef", "a-z": "abcdefghijklmnopqrstuvwxyz"}
    shares = {k: rejected(made(v)) for k, v in kinds.items()}
    print("limit", model.limit, getattr(model, "unknown", None), "held out", len(held_out), rejected(held_out), shares)
    assert rejected(held_out) <= 0.002 and len(held_out) > 2000
    assert all(shares[k] >= 0.9 for k in ("greek", "cyrillic", "cjk", "junk")), shares


def test_pieces_of_texts_are_laid_again(monkeypatch):
    monkeypatch.setattr("runlens.llm.pieces._LAID", 3)
    texts = ["", "a b\0c \U0001d4b3 a", "b", "", "a a a a a b"]
    found, numbers, stops = marked(pa.array([t.encode().replace(b" ", MARK + b" ") for t in texts], pa.large_binary()), MARK)
    assert sorted(found) == sorted(["", "a", " b\0c", " \U0001d4b3", " a", "b", " b"])
    assert Parts([x.encode() for x in found]).laid(numbers, stops) == [t.encode() for t in texts]
    wide = Parts([np.array([len(x), 70_000], "<u4").tobytes() for x in found], 4).laid(numbers, stops)
    assert [len(x) for x in wide] == [8 * (t.count(" ") + 1) for t in texts]


def test_words_beside_line_breaks_are_laid_in_lines():
    """They and words with punctuation whose core is known make no work for the library's search for words."""
    path, searched = P.path("byte_bpe_50k.json"), []
    cache = WordCache(path, spaces=True, lower=False)
    raw, words = cache._raw, cache._words
    cache._raw = lambda texts: searched.extend(texts) or raw(texts)
    lined = []
    cache._words = lambda some: lined.extend(some) or words(some)
    texts = ["Wort vor zeile.\nNach zeile, vor", "Anders nach,\nanders vor\nÄnderung.", "a\n\nb", "a\n\tb", "\na", "Nach vor! Nach, vor;"]
    for text in texts:
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cache.encode([text])[0], cache.kind).tolist() == want
    assert not any("zeile" in x or "nder" in x for x in searched)
    assert sorted(lined) == sorted(set(lined)) and lined.count("vor") == 1


def test_marked_words_are_cut_before_white_space():
    rng = random.Random(29)
    texts = ["", " ", "\0", "a  b", *("".join(rng.choice("ab .,\n\t \u3000\u00a0\u0085\x1c\0é\U0001d4b3'") for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    column = bpe.marked_words(pa.array([t.encode() for t in texts], pa.binary()))
    findall = regex.compile(P.PATTERN).findall
    for text, cut in zip(texts, column.to_pylist()):
        words = [w.decode() for w in cut.split(MARK)]
        assert "".join(words) == text and [m for w in words for m in findall(w)] == findall(text)
