"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before it kept, read again from Parquet,
and all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runlens.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from runlens.llm.queries import historical, id_crc
from runlens.llm.shared import cut_lineage, documents, keep_rows


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go: those without a letter and those it cannot place at all."""
    return language_id.accept(docs, language_id.train(docs, id_crc(4) != 2))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, exact_dedup.dedup(docs, historical()).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return keep_rows(docs, simhash.near_duplicates(docs).filter("kept"))


#: Bytes of a repeat that is cut out. 99 of 100 repeats of over 50 words have as many, but only 65 have the 400 of op8's contract.
PASSAGE_BYTES = 200


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that stand anywhere else go out of the texts; every document stays, if with an empty text."""
    return suffix_dedup.shorten(docs, length=PASSAGE_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL has neither the classifier nor XXH64 fingerprints nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
