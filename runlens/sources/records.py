"""Readers for the record files an orchestrator leaves behind.

Each reader takes a Spark path (local, HDFS or object store), uses an explicit
schema and returns a fixed column order. Hive-style partition folders give
`dag_id`/`run_id`/`deployment_id` filters that prune folders.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True)
    return reader.options(**options).json(path).select(*schema.fieldNames())


def shape_records(texts: DataFrame, kind: str) -> DataFrame:
    """Records held as JSON text, (path, text), as typed rows with `path` and `reason`.

    The columns are those of the reader of that kind. Text that is no JSON object gives
    nulls and the reason `not_json`; a null text `no_text`; a value that does not fit its
    column is null there, the rest of the record stays, with the reason `bad_value`.
    """
    schema = schemas.BY_KIND[kind]
    held = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    parsed = texts.select("path", "text", F.from_json("text", held, {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    sound = F.col("r.__bad").isNull()
    is_object = F.json_object_keys("text").isNotNull()
    reason = F.when(F.col("text").isNull(), "no_text").when(~is_object, "not_json").when(~sound, "bad_value")
    shaped = parsed.select(*[F.col(f"r.{name}").alias(name) for name in schema.fieldNames()], "path", reason.alias("reason"))
    if kind == "deployments":
        return _with_defaults(shaped)
    return _with_log_time(shaped) if kind == "logs" else shaped


def records_and_errors(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records that could be read, and (path, reason) of what could not, or not wholly."""
    lost = F.coalesce(F.col("reason").isin("no_text", "not_json"), F.lit(False))
    return shaped.filter(~lost).drop("path", "reason"), shaped.filter("reason IS NOT NULL").select("path", "reason")


def record_errors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, reason) of the record files (lines of log files) of a kind below `path` that cannot be read."""
    reader = spark.read.option("recursiveFileLookup", True)
    texts = reader.text(path, wholetext=kind != "logs").filter(F.trim("value") != "")
    return records_and_errors(shape_records(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), kind))[1]


def read_dag_runs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.DAG_RUNS)


def read_task_states(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.TASK_STATES)


def read_task_contexts(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.TASK_CONTEXTS)


def explode_attempts(contexts: DataFrame) -> DataFrame:
    """The flat attempts table."""
    return contexts.select("dag_id", "run_id", "task_id", F.inline("attempts"))


def read_deployments(spark: SparkSession, path: str) -> DataFrame:
    """Deployments with the scheduler's mark as a plain column, and `pinned`."""
    raw = _read(spark, path, schemas.DEPLOYMENTS)
    return _with_defaults(raw)


def _with_defaults(raw: DataFrame) -> DataFrame:
    overrides = F.coalesce("variable_overrides", F.lit("{}"))
    return raw.withColumns({
        "enabled": F.coalesce("enabled", F.lit(True)),
        "catch_up": F.coalesce("catch_up", F.lit(False)),
        "timezone": F.coalesce("timezone", F.lit("UTC")),
        "last_scheduled_at": F.col("_scheduler.last_scheduled_at"),
        "pinned": F.regexp_replace(overrides, r"\s", "") != "{}",
    }).drop("_scheduler")


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.TRIGGERS)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSONL log lines of tasks and framework; identity comes from the lines."""
    logs = (
        spark.read.schema(schemas.LOGS).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,jsonl,txt}*").json(path)
    )
    return _with_log_time(logs)


def _with_log_time(logs: DataFrame) -> DataFrame:
    micros = F.timestamp_micros((F.col("ts") * 1e6).cast("long"))
    extra = [name for name in ("path", "reason") if name in logs.columns]
    return logs.select(*schemas.LOGS.fieldNames(), micros.cast("timestamp_ntz").alias("logged_at"), *extra)


def dag_requirements(deployments: DataFrame) -> DataFrame:
    """Stored variable requirements as (deployment_id, var_key, has_default, default_value, overridden)."""
    spec = F.from_json(
        F.coalesce("variable_requirements", F.lit("{}")),
        "map<string, struct<has_default: boolean, default_value: string>>",
    )
    given = F.json_object_keys(F.coalesce("variable_overrides", F.lit("{}")))
    return deployments.select(
        F.col("id").alias("deployment_id"), given.alias("given"), F.explode(spec).alias("var_key", "spec")
    ).select(
        "deployment_id", "var_key",
        F.coalesce("spec.has_default", F.lit(False)).alias("has_default"),
        "spec.default_value",
        F.array_contains("given", F.col("var_key")).alias("overridden"),
    )


def deployment_overrides(deployments: DataFrame) -> DataFrame:
    """Stored overrides as (deployment_id, var_key, var_value)."""
    pairs = F.from_json(F.coalesce("variable_overrides", F.lit("{}")), "map<string,string>")
    return deployments.select(
        F.col("id").alias("deployment_id"), F.explode(pairs).alias("var_key", "var_value")
    )


# Column kinds of the relational layout: text times, JSON text, 0/1 flags.
_TIMES = {
    "dag_runs": ("logical_date", "created_at", "ended_at"),
    "task_states": ("heartbeat_at", "updated_at"),
    "deployments": ("start_date", "end_date", "created_at", "updated_at"),
    "triggers": ("created_at", "claimed_at"),
}
_FLAGS = {"deployments": ("catch_up", "enabled")}


def normalize_sql_export(df: DataFrame, table: str) -> DataFrame:
    """Rows of the relational store (from JDBC or a Parquet export) to typed columns."""
    if table == "task_contexts":
        parsed = F.from_json("context", schemas.TASK_CONTEXTS)
        return df.select(parsed.alias("c")).select("c.*")
    changes = {
        name: F.col(name).try_cast("timestamp_ntz")
        for name in _TIMES.get(table, ()) if name in df.columns
    }
    changes |= {name: F.col(name) != 0 for name in _FLAGS.get(table, ()) if name in df.columns}
    for name in ("variables", "variable_overrides", "variable_requirements"):
        if name in df.columns:
            changes[name] = F.coalesce(name, F.lit("{}"))
    if table == "deployments":
        if "owners" in df.columns:
            changes["owners"] = F.from_json(F.coalesce("owners", F.lit("[]")), "array<string>")
        if "labels" in df.columns:
            changes["labels"] = F.from_json(F.coalesce("labels", F.lit("{}")), "map<string,string>")
        if "_scheduler" in df.columns:
            mark = F.get_json_object("_scheduler", "$.last_scheduled_at")
            changes["last_scheduled_at"] = mark.try_cast("timestamp_ntz")
        if "variable_overrides" in df.columns:
            changes["pinned"] = F.regexp_replace(changes["variable_overrides"], r"\s", "") != "{}"
    return df.withColumns(changes).drop("_scheduler")
