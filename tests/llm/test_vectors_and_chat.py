"""Vectors and conversations against brute force; components; the pipeline on a small folder."""

import hashlib
import random

import numpy as np
from odd_tables import odd_rows, table  # noqa: F401 - a fixture
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import chat, vector_dedup
from runlens.llm.components import components


def closure(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    for pairs in (
        [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(99, i) for i in range(30)],
        [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
    ):
        df = spark.createDataFrame([*pairs, (None, 5)], "x long, y long")
        got = {r.node: r.root for r in components(df, "x", "y").collect()}
        linked = {n for p in pairs if p[0] != p[1] for n in p}
        assert got == {n: r for n, r in closure(linked, [p for p in pairs if p[0] != p[1]]).items()}


def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    for center in rng.normal(size=(12, 24)):
        for _ in range(rng.integers(1, 40)):
            rows.append((center + 0.06 * rng.normal(size=24)).tolist())
    rows += [[0.0] * 24, [1.0, float("nan"), *[0.0] * 22], [float("inf")] * 24, [1.0, None], [], None]
    rows += [rows[3], rows[3], [2 * x for x in rows[3]], [1.0, 2.0], [1.0, 2.0, 0.0], [3e38] * 24, [1e-30] * 24, [-1e-30] * 24]
    ids = [*range(len(rows) - 2), None, 7]
    return list(zip(ids, rows))


def test_vector_dedup(spark, monkeypatch):
    rows = vector_rows()
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / max(map(abs, rows[i][1])) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    pairs = [(i, j) for i in good for j in good if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    root = closure(range(len(rows)), pairs)
    names = {r: min((rows[i][0] for i in root if root[i] == r and rows[i][0] is not None), default=None) for r in root.values()}
    links = {i: sum(i in p for p in pairs) for i in root}
    want = sorted(((rows[i][0], links[i], names[root[i]]) for i in root), key=repr)
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, tab string")
    for block in (256, 4):
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        got = vector_dedup.near_duplicates(df)
        found = sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=repr)
        missed = sum(w[1] for w in want) - sum(f[1] for f in found)
        assert 0 <= missed <= 0.05 * sum(w[1] for w in want)
        if not missed:
            assert found == want
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_more_rows_need_more_tables():
    small, large = vector_dedup.Tables.for_rows(1000), vector_dedup.Tables.for_rows(10_000_000)
    assert small.projections < large.projections and small.tables < large.tables
    near = vector_dedup.collide(np.sqrt(0.2))
    for t in (small, large):
        assert 1 - (1 - near**t.projections) ** t.tables >= vector_dedup.RECALL


CONTROL_TEXT = r"a \ b \\ <|im_start|>x<|im_end|>" + "\n</s>[INST] ok [/INST] <<SYS>> <</SYS>> <s> <\\s> [[INST]\\n"


def test_escapes_are_reversible_and_break_control_strings(spark):
    texts = ["", "\\", "\\\\", CONTROL_TEXT, "<<s>", "<|im_start|", "plain é 日本", *(s * 2 for s in chat.CONTROL)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("b", chat.unescape(F.col("e"))).collect():
        assert r.b == r.t and not any(s in r.e for s in chat.CONTROL)


def test_reply_trees(spark):
    """A tree with branches: the best paths by mean score; all paths without a limit; and a cycle that has none."""
    nodes = spark.createDataFrame(
        [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 3.0),
         ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", CONTROL_TEXT, 3.0), ("t", 6, 99, "user", "orphan", None),
         ("u", 1, 2, "user", "x", 1.0), ("u", 2, 1, "user", "y", 1.0)],
        "tree_id string, node_id long, parent_id long, role string, text string, score double",
    )
    every = chat.format_paths(nodes)
    assert sorted((r.tree_id, r.leaf) for r in every.collect()) == [("t", 2), ("t", 5), ("t", 6)]
    best = chat.format_paths(nodes, branches=2)
    assert sorted((r.rank, r.leaf) for r in best.collect()) == [(1, 5), (2, 2)]
    read = best.select("leaf", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    turns = {r.leaf: [tuple(t) for t in r.turns] for r in read}
    assert turns == {
        5: [("user", "hi"), ("assistant", "b"), ("user", "more"), ("assistant", CONTROL_TEXT)],
        2: [("user", "hi"), ("assistant", "a")],
    }
    assert {r.leaf: list(r.loss) for r in read} == {5: ["b", CONTROL_TEXT], 2: ["a"]}
    assert chat.format_paths(nodes.limit(0)).count() == 0


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 7, None, None), (1, 3, "tool\nx", ""), (None, 1, "assistant", "n"),
            (None, None, "user", "first"), (2, 1, "assistant", ""), (3, 5, "system", "long " * 20_000)]
    rows += [(4, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, leaf string, dist string")
    out = chat.format_paths(chat.chains(df, "conv_id", "turn", "role", "text"), branches=1)
    got = {
        r.c: ([tuple(t) for t in r.turns], "".join(r.loss))
        for r in out.select(F.col("tree_id.id").alias("c"), chat.read_turns(F.col("formatted")).alias("turns"),
                            chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    }
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for c in (1, 2, 3, 4, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        want[c] = turns, "".join(t for role, t in turns if role == "assistant")
    assert got == want


def test_main_path_of_reply_trees_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.chains(df, "conv_id", "turn", "role", "text"), branches=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, odd_rows, tmp_path):  # noqa: F811
    """Each stage against brute force on its own input; the rows it returns are those of the stages one by one."""
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id + 1000, r.text, r.lang) for r in prose] + [(i, t) for i, t in odd_rows]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert docs.columns == columns
        after = docs.collect()
        sizes.append(len(after))
        if name == "language_id":
            gone = [r for r in before if r not in after]
            assert all(r in before for r in after) and len(gone) < 12
            assert not any(r.text is None or not any(map(str.isalpha, r.text)) for r in after)
        if name == "exact_dedup":
            assert len(after) == len({hashlib.sha256((r.text or "").encode().lower()).digest() for r in before})
        if name == "suffix_array_dedup":
            assert sorted(r.doc_id or 0 for r in after) == sorted(r.doc_id or 0 for r in before)
            assert sum(len(r.text) for r in after) < sum(len(r.text) for r in before)
            assert all(r.n_chars == len(r.text) for r in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    pick = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    total = lambda df: df.agg(F.sum("length"), F.count("*")).first()
    assert total(whole.select(*pick)) == total(packed.select(*pick)) and sizes == sorted(sizes, reverse=True)
