"""Session defaults and lineage cutting."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "runlens", cores: str = "*") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, one per application.

    A session on a cluster must name it; only a local one, as in tests, gets a
    folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/runlens/{context.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from its files.

    Iterative operators call this once per step, so a lost executor re-reads
    the last step instead of re-running all of them. A table rather than
    `checkpoint()`, because a scan starts with fresh constraints and true
    sizes: a checkpointed plan inherits the constraints of the plan before it,
    and over a loop of joins they double at every step.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
