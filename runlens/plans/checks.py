"""Registry of queries and the SQL each is compared with."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.plans.views import History, check_sql

QUERIES: dict[str, Callable[[History], DataFrame]] = {}
SQL: dict[str, str] = {}

# The moment the queries take as now.
NOW = "2024-01-06 12:07:30"


def check(name: str, sql: str | None = None):
    """Register a query, and the SQL (with {table} marks) that gives the same rows."""

    def register(fn: Callable[[History], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = check_sql(sql)
        return fn

    return register


def moment(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def listed(column: str) -> Column:
    """Comma text to an array; empty text gives an empty array."""
    return F.filter(F.split(column, ","), lambda item: item != "")


def catalog(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("upstream", listed("upstream_list"))


def contexts(h: History) -> DataFrame:
    """Task contexts with nested attempts, from the flat attempts."""
    attempts = F.array_sort(F.collect_list(F.struct("attempt_number", "state", "error")))
    return h.fx_attempts.groupBy(
        "task_no", "retries", "retry_delay", "exponential_backoff"
    ).agg(attempts.alias("attempts"))


def big(column: str) -> Column:
    return F.col(column).cast("long").alias(column)
