"""A table played as a stream: its rows arrive in lots, and the query starts anew for each lot."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.session import scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def replay(df: DataFrame, lot: Column, lots: int, start: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Runs a stream over `df` as if its rows came lot by lot, `lot` being 0 to lots - 1.

    `start(stream, checkpoint)` starts a query that ends when it has read what is
    there. It is called once per lot with the same checkpoint, so every lot after the
    first is also a restart from the state that the one before left. Rows whose
    lot is null or out of range never arrive.
    """
    spark = df.sparkSession
    folder = f"{scratch(spark)}/replay-{uuid.uuid4().hex}"
    schema = df.schema
    arriving = df.withColumn("__lot", lot.cast("int")).filter(F.col("__lot").between(0, lots - 1))
    arriving.write.partitionBy("__lot").parquet(f"{folder}/held")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i in range(lots):
        # a lot arrives when its folder moves to where the stream looks: its rows are written once
        lot_folder, arrived = path(f"{folder}/held/__lot={i}"), path(f"{folder}/in/{i}")
        files.mkdirs(arrived.getParent())
        if not (files.rename(lot_folder, arrived) if files.exists(lot_folder) else files.mkdirs(arrived)):
            raise OSError(f"{lot_folder} could not be moved to {arrived}")
        query = start(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), f"{folder}/checkpoint")
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()


def replayed(df: DataFrame, lot: Column, lots: int, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `stream` gives out over all lots, from an append-only file sink."""
    spark = df.sparkSession
    out = f"{scratch(spark)}/replayed-{uuid.uuid4().hex}"
    made = {}

    def start(rows: DataFrame, checkpoint: str) -> StreamingQuery:
        given = stream(rows)
        made["schema"] = given.schema
        return (
            given.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )

    replay(df, lot, lots, start)
    return spark.read.schema(made["schema"]).parquet(out)
