"""Record files as streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas


def stream_source(
    spark: SparkSession, kind: str, path: str, max_files: int | None = None
) -> DataFrame:
    """New record files of `kind` below `path`, in the batch readers' column order."""
    schema = schemas.BY_KIND[kind]
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if kind != "logs":
        reader = reader.option("multiLine", True)
    return reader.json(path).select(*schema.fieldNames())


def tail(
    logs: DataFrame, dag_id: str, run_id: str, task_id: str, attempt: int = 1
) -> DataFrame:
    """Lines of one task attempt as they are appended."""
    return logs.filter(
        (F.col("source") == "task") & (F.col("dag_id") == dag_id)
        & (F.col("run_id") == run_id) & (F.col("task_id") == task_id)
        & (F.coalesce("attempt", F.lit(1)) == attempt)
    )


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
