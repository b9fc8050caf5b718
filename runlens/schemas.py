"""Explicit schemas of every record kind; readers never infer."""

from pyspark.sql import types as T

_S, _NTZ = T.StringType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DAG_RUNS = _struct(
    run_id=_S, dag_id=_S, dag_version=_S, state=_S, logical_date=_NTZ,
    deployment_id=_S, variables=_S, created_at=_NTZ, ended_at=_NTZ,
)

TASK_STATES = _struct(
    run_id=_S, dag_id=_S, task_id=_S, state=_S, heartbeat_at=_NTZ, updated_at=_NTZ,
)

ATTEMPT = _struct(
    attempt_number=T.IntegerType(), state=_S, started_at=_NTZ, ended_at=_NTZ,
    duration_sec=T.DoubleType(), error=_S, error_traceback=_S, executor=_S,
    executor_ref=_S,
)

TASK_CONTEXTS = _struct(
    run_id=_S, dag_id=_S, task_id=_S, dag_version=_S, run_date=_NTZ,
    logical_date=_NTZ, data_interval_start=_NTZ, data_interval_end=_NTZ,
    variables=_S, inputs=_S, outputs=_S, upstream_outputs=_S, plugin_name=_S,
    retries=T.IntegerType(), retry_delay=T.IntegerType(),
    execution_timeout=T.IntegerType(), exponential_backoff=T.BooleanType(),
    attempts=T.ArrayType(ATTEMPT),
)

DEPLOYMENTS = _struct(
    id=_S, dag_id=_S, dag_version=_S, desc=_S, cron=_S, timezone=_S,
    start_date=_NTZ, end_date=_NTZ, catch_up=T.BooleanType(),
    enabled=T.BooleanType(), max_active_runs=T.IntegerType(),
    variable_overrides=_S, variable_requirements=_S, owners=T.ArrayType(_S),
    labels=T.MapType(_S, _S), _scheduler=_struct(last_scheduled_at=_NTZ),
)

TRIGGERS = _struct(
    trigger_id=_S, deployment_id=_S, variables=_S, created_at=_NTZ,
    claimed_by=_S, claimed_at=_NTZ,
)

LOGS = _struct(
    ts=T.DoubleType(), level=_S, msg=_S, logger=_S, source=_S, dag_id=_S,
    run_id=_S, task_id=_S, attempt=T.IntegerType(), extra=_S, exc_info=_S,
)

TASKS = _struct(
    bundle_path=_S, dag_id=_S, task_id=_S, type=_S, desc=_S, uses=_S,
    upstream=T.ArrayType(_S), teardown=_S, trigger_rule=_S, inputs=_S,
    default_inputs=_S, retries=T.IntegerType(), retry_delay=T.IntegerType(),
    execution_timeout=T.IntegerType(), exponential_backoff=T.BooleanType(),
    success=T.ArrayType(_S), failure=T.ArrayType(_S), fail_mode=_S,
    check_interval=T.DoubleType(), group_path=_S, group_upstream=T.ArrayType(_S),
    group_trigger_rule=_S, position=T.IntegerType(), project=_S,
    owners=T.ArrayType(_S), labels=T.MapType(_S, _S),
)

VARIABLES = _struct(
    scope=_S, depth=T.IntegerType(), is_dag_scope=T.BooleanType(), var_key=_S,
    var_value=_S,
)

PLAN_ISSUES = _struct(dag_id=_S, task_id=_S, severity=_S, category=_S, message=_S)

# What a reader of record files can be asked for, by kind.
BY_KIND = {
    "dag_runs": DAG_RUNS,
    "task_states": TASK_STATES,
    "task_contexts": TASK_CONTEXTS,
    "deployments": DEPLOYMENTS,
    "triggers": TRIGGERS,
    "logs": LOGS,
}
