"""User functions over rows, with outcomes captured instead of raised."""

import json
import time
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class TaskSkipped(Exception):
    """The task decides that it is to be skipped; it is not tried again."""


class TaskFailed(Exception):
    """The task fails for good; it is not tried again."""


class TaskRetry(Exception):
    """The task asks for another attempt."""


_FINAL = (TaskSkipped, TaskFailed, NotImplementedError)

OUTCOME = T.StructType([
    T.StructField("attempt_state", T.StringType()),
    T.StructField("outputs", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_traceback", T.StringType()),
    T.StructField("retry_allowed", T.BooleanType()),
    T.StructField("duration_sec", T.DoubleType()),
])


def _as_outputs(result) -> str:
    if result is None:
        return "{}"
    return json.dumps(result if isinstance(result, dict) else {"_result": result}, default=str)


def _attempt(run: Callable, row: dict) -> tuple:
    start = time.perf_counter()
    try:
        outcome = ("success", _as_outputs(run(row)), None, None, False)
    except TaskSkipped as error:
        outcome = ("skipped", "{}", str(error) or None, None, False)
    except TimeoutError as error:
        outcome = ("timed_out", "{}", str(error), None, True)
    except Exception as error:  # noqa: BLE001 - user code may raise anything
        text = str(error) or ("retry requested" if isinstance(error, TaskRetry) else "")
        outcome = ("failed", "{}", text, traceback.format_exc(), not isinstance(error, _FINAL))
    return (*outcome, time.perf_counter() - start)


def map_tasks(df: DataFrame, fn: Callable | dict[str, Callable]) -> DataFrame:
    """Call `fn` with every row as a dict and append what came of it.

    With a dict of functions each row's `plugin_name` picks one; a name that
    is not in it gives a failed attempt that may not be retried. The rows are
    dealt anew: small files may hold very many, and a call may take long.
    """

    def pick(row: dict) -> Callable:
        if callable(fn):
            return fn
        if row["plugin_name"] not in fn:
            raise NotImplementedError(f"Plugin {row['plugin_name']!r} is not registered")
        return fn[row["plugin_name"]]

    added = OUTCOME.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = [
                _attempt(lambda row: pick(row)(row), row) for row in batch.to_dict("records")
            ]
            yield pd.concat(
                [batch.reset_index(drop=True), pd.DataFrame(outcomes, columns=added)], axis=1
            )

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts).mapInPandas(run, T.StructType([*df.schema.fields, *OUTCOME.fields]))
