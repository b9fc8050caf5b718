"""The operators over the given tables, as registered queries."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    alignment, bpe, chat, exact_dedup, language_id, language_model, packing, ranking, simhash, suffix_dedup, token_files, toxicity,
    vector_dedup,
)
from runlens.llm.shared import documents


def id_crc(modulus: int, column: str = "doc_id"):
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def historical():
    """Which documents stand for the corpus at hand before the rest is delivered."""
    return id_crc(2) == 0


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The table plays both parts: half of its ids, by crc32, are the history, the others the delivery."""
    return exact_dedup.dedup(documents(spark, folder), historical()).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""


def op2_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


#: All pairs of vectors, and the links' closure.
OP2_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, root AS component_id, root = e.vec_id AS kept
FROM embeddings e JOIN roots ON roots.a = e.vec_id
"""


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_spans(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), 2)


OWN_CONVERSATION = """
SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(column1 AS BIGINT) AS turn, column2 AS role, column3 AS text
FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
"""


def op5_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.sql(OWN_CONVERSATION.replace("column1", "col1").replace("column2", "col2").replace("column3", "col3"))
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_paths(chat.chains(rows, "conv_id", "turn", "role", "text"), branches=1)
    turns = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        F.col("tree_id.id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), escaped AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
         + len(regexp_extract_all(text, '<\\|im_start\\|>|<\\|im_end\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|endoftext\\|>|<\\|startoftext\\|>')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + chars + 11) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Packed pieces with the crc32 of their ids instead of the ids."""
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")

    def summed(batches):
        for b in batches:
            crcs = []
            for ids, n in zip(b.column("ids").to_pylist(), b.column("length").to_pylist()):
                crcs.append(zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(crcs, pa.int64())], names=[*names, "ids_crc32"]
            )

    return pieces.mapInArrow(summed, ", ".join(f"{n} long" for n in (*names, "ids_crc32")))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(packing.pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), 1))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(
        documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True
    )


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(documents(spark, folder)))


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scores = language_model.score(documents(spark, folder), id_crc(5) != 1)
    return scores.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = id_crc(4) == 2
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(
        documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


#: Every document's terms are counted, then met with the items' terms.
OP12_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, uid, regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM (
    SELECT doc_id, row_number() OVER () AS uid, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
    FROM documents WHERE text IS NOT NULL)
), sizes AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM docs WHERE len(terms) > 0
), item_terms AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), tf AS MATERIALIZED (
  SELECT doc_id, uid, n, term, count(*) AS tf FROM (SELECT doc_id, uid, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, uid,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * sizes.docs) // sizes.terms))))::BIGINT AS score
  FROM tf JOIN weights USING (term) JOIN item_terms USING (term), sizes GROUP BY item_id, doc_id, uid
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = documents(spark, folder), id_crc(3) == 1
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~held_out)
    return toxicity.judge(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_reply_trees": op5_reply_trees,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_model": op9_language_model,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_toxicity": op13_toxicity,
}

SQL = {"op1_exact_dedup": OP1_SQL, "op2_vector_dedup": OP2_SQL, "op5_reply_trees": OP5_SQL, "op12_lexical_search": OP12_SQL}
