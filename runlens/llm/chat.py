"""Reply trees: root-to-leaf paths, ranked, each formatted as one conversation with a loss mask.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from runlens.llm.shared import cut_lineage

#: Marks of a turn, and other control strings that must not come out of a text unbroken.
TURN, END = "<|im_start|>", "<|im_end|>"
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")

#: Tasks that a tree's leaves are ranked in before the last comparison.
SALTS = 32

_QUOTED = "|".join("".join("\\" + c if c in "<|>[]/" else c for c in s[1:]) for s in CONTROL)


def escape(text: Column) -> Column:
    """Reversible: backslashes are doubled, and each control string gets one after its first character.

    Control strings hold no backslash and start with `<` or `[`, so what follows
    a single backslash is never one, and no control string is left in the result.
    """
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={_QUOTED})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def chains(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversations given by rows as trees without branches: each row answers the one before it.

    Rows are ordered by turn, then role, then text, so repeated and missing turn
    numbers are allowed; nulls come first. Null roles and texts are empty. Rows
    without a conversation id are one conversation (`tree_id` is a struct, so that
    a missing id is a key like any other).
    """
    rows = turns.select(
        F.struct(F.col(conv).alias("id")).alias("tree_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    node = F.row_number().over(Window.partitionBy("tree_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree_id", node.alias("node_id"), "role", "text").withColumn(
        "parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    ).withColumn("score", F.lit(0.0))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaf, node_id, dist): the nodes of every root-to-leaf path; dist 0 is the leaf.

    Self-joins by doubling: the k-th round knows each node's ancestor 2^k steps up
    and lengthens every path by as many nodes, so a tree of depth d takes log2(d)
    rounds. Each round is written as a table. A node whose parent is missing is a
    root; nodes on a cycle belong to no path that ends, and are left out.
    """
    known = cut_lineage(nodes.select("tree_id", "node_id", "parent_id"))
    ids = known.select("tree_id", F.col("node_id").alias("parent_id"))
    up = cut_lineage(known.join(ids, ["tree_id", "parent_id"], "left_semi").select("tree_id", "node_id", F.col("parent_id").alias("up")))
    leaves = known.join(up.select("tree_id", F.col("up").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_anti")
    found = cut_lineage(leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("dist")))
    step, at_most = 1, known.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    while step <= at_most and not up.isEmpty():
        more = found.join(up, ["tree_id", "node_id"]).select("tree_id", "leaf", F.col("up").alias("node_id"), F.col("dist") + step)
        found = cut_lineage(found.unionByName(more.toDF("tree_id", "leaf", "node_id", "dist")))
        higher = up.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("top"))
        up = cut_lineage(up.join(higher, ["tree_id", "up"]).select("tree_id", "node_id", F.col("top").alias("up")))
        step *= 2
    return found


def choose(found: DataFrame, nodes: DataFrame, branches: int | None) -> DataFrame:
    """(tree_id, leaf, rank): the paths with the highest mean score, ties by the smaller leaf; `branches` None: all.

    A tree with very many leaves is first cut to its best in each of SALTS groups.
    """
    scores = found.join(nodes.select("tree_id", "node_id", "score"), ["tree_id", "node_id"]).groupBy("tree_id", "leaf").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("mean")
    )
    if branches is None:
        return scores.select("tree_id", "leaf", F.lit(None).cast("int").alias("rank"))
    order = [F.desc("mean"), F.asc("leaf")]
    part = Window.partitionBy("tree_id", "salt").orderBy(*order)
    first = cut_lineage(scores).withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    first = first.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= branches)
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(*order)).alias("rank")
    return first.select("tree_id", "leaf", rank).filter(F.col("rank") <= branches)


def format_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: tree_id, leaf, rank, formatted, loss_spans.

    `nodes`: tree_id, node_id (unique in its tree), parent_id (null or unknown for
    roots), role, text, score (nulls count as 0). `loss_spans` are the begins (from
    0) and lengths, in code points, of the assistant's escaped texts in `formatted`.
    One path is one conversation and meets in one row; nothing wider does. An
    empty table gives no rows.
    """
    nodes = cut_lineage(nodes.select("tree_id", "node_id", "parent_id", "role", "text", "score"))
    found = paths(nodes)
    chosen = cut_lineage(choose(found, nodes, branches))
    members = found.join(chosen, ["tree_id", "leaf"]).join(nodes.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    turn = F.struct(
        F.col("dist").alias("dist"),
        F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    turns = members.groupBy("tree_id", "leaf", "rank").agg(F.sort_array(F.collect_list(turn), asc=False).alias("turns"))
    tail = len(END) + 1
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + tail).alias("at"),
            F.when(t["loss"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.char_length(t["head"])).alias("begin"), F.char_length(t["body"]).cast("long").alias("length")
            )))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return turns.select("tree_id", "leaf", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    marked = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(marked, F.lit(1), F.size(marked) - 1)
    head = rf"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n"
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), s["length"].cast("int"))))
