"""What several operators of this package need: scratch tables, shared files, row keys."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import cut_lineage

__all__ = [
    "cut_lineage", "documents", "filesystem", "keep_rows", "mix", "no_collection", "raw_hash", "release_memory", "shared_folder",
    "shuffles_dropped", "slices", "worker_texts",
]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that `spark.checkpoint.dir` names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        cut_lineage(spark.range(1))  # sets the folder of a local session, or explains what is missing
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The file system of a shared folder and the path in it, for tasks that read or write files there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


#: Spark's own limit on the bytes of a batch for Python workers, and the one used here unless the session sets another.
_ARROW_BYTES, SPARK_DEFAULT, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def worker_texts(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Only the id and the text as UTF-8 bytes (null: empty), under fixed names.

    Where the session has not set the size of Arrow batches, it is lowered: texts
    are long, and what Python makes of a batch is several times its size.
    """
    if docs.sparkSession.conf.get(_ARROW_BYTES, SPARK_DEFAULT) == SPARK_DEFAULT:
        docs.sparkSession.conf.set(_ARROW_BYTES, SMALL)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
        *more,
    )


def raw_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `kept` (doc_id, text_hash) names, with all their columns, one of each.

    A row is named by its id and the hash of its text, so rows that share an id
    but not a text are told apart; repeats of one row leave one.
    """
    id_, text_hash = F.col(id_col).cast("long"), raw_hash(text_col)
    names = ("__keep_id", "__keep_null", "__keep_hash")
    rows = docs.withColumns(dict(zip(names, (F.coalesce(id_, F.lit(0)), id_.isNull(), text_hash))))
    wanted = kept.select(
        F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), F.col("text_hash").alias(names[2])
    )
    return rows.join(wanted, list(names), "left_semi").dropDuplicates(list(names)).drop(*names)


def mix(x):
    """Scrambles a numpy array of unsigned 64-bit integers (the splitmix64 finalizer)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list, size: int):
    """Index ranges of `texts` that hold about `size` bytes each, so that what is made of them stays small."""
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and total < size:
            total += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


@contextmanager
def no_collection():
    """Without searches for cycles: they would go through all of a large cache whenever some small objects are made."""
    import gc

    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def release_memory() -> None:
    """Gives back to the system what a worker process holds of earlier tasks without using it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files go as soon as a table is written, not when the driver next collects garbage: later steps read the table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )
