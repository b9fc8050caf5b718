"""Record files and YAML documents, written to a folder and read back."""

import datetime as dt
import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlens.operators import aggregates, tasks
from runlens.operators import graph as G
from runlens.operators import variables as V
from runlens.sources import documents, records, sinks


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=2))


def test_run_records(spark, tmp_path):
    for n, state in enumerate(["running", "success"]):
        put(tmp_path / f"dag_id=g{n}" / f"r{n}.json", {
            "run_id": f"r{n}", "dag_id": f"g{n}", "dag_version": "v1", "state": state,
            "logical_date": "2026-01-01 00:00:00" if n else "2026-01-01T00:00:00",
            "variables": {"a": 1, "b": {"c": 2}}, "created_at": "2026-01-01 00:00:01.5", "ended_at": None,
        })
    runs = records.read_dag_runs(spark, str(tmp_path))
    assert runs.columns[:4] == ["run_id", "dag_id", "dag_version", "state"]
    assert rows(runs, "run_id", "dag_id", "logical_date", "deployment_id") == [
        ("r0", "g0", dt.datetime(2026, 1, 1), None), ("r1", "g1", dt.datetime(2026, 1, 1), None),
    ]
    assert json.loads(runs.first()["variables"]) == {"a": 1, "b": {"c": 2}}
    pruned = runs.filter("dag_id = 'g1'")
    assert rows(pruned, "run_id") == [("r1",)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dag_id" in plan


def test_state_and_context_records(spark, tmp_path):
    base = tmp_path / "states" / "dag_id=g" / "run_id=r"
    put(base / "t.json", {"run_id": "r", "dag_id": "g", "task_id": "t", "state": "running",
                          "heartbeat_at": "2026-01-01T00:00:00", "updated_at": "2026-01-01T00:00:05"})
    states = records.read_task_states(spark, str(tmp_path / "states"))
    assert rows(states, "dag_id", "run_id", "task_id", "heartbeat_at") == [("g", "r", "t", dt.datetime(2026, 1, 1))]
    put(tmp_path / "ctx" / "dag_id=g" / "run_id=r" / "t.json", {
        "run_id": "r", "dag_id": "g", "task_id": "t", "outputs": {"rows": 3}, "retries": 2, "retry_delay": 10,
        "exponential_backoff": True, "attempts": [
            {"attempt_number": 1, "state": "failed", "error": "x", "started_at": "2026-01-01T00:00:00", "ended_at": "2026-01-01T00:00:02"},
            {"attempt_number": 2, "state": "success"}],
    })
    contexts = records.read_task_contexts(spark, str(tmp_path / "ctx"))
    assert json.loads(contexts.first()["outputs"]) == {"rows": 3}
    assert rows(records.explode_attempts(contexts), "task_id", "attempt_number", "state") == [("t", 1, "failed"), ("t", 2, "success")]


def test_deployments_and_triggers(spark, tmp_path):
    put(tmp_path / "d" / "a.json", {
        "id": "a", "dag_id": "g", "cron": "0 0 * * *", "variable_overrides": {"x": "1"},
        "variable_requirements": {"x": {"has_default": False}, "y": {"has_default": True, "default_value": "d"}},
        "labels": {"team": "t"}, "owners": ["o"], "_scheduler": {"last_scheduled_at": "2026-01-02T00:00:00"}})
    put(tmp_path / "d" / "b.json", {"id": "b", "dag_id": "g", "variable_overrides": {}, "enabled": False})
    deps = records.read_deployments(spark, str(tmp_path / "d"))
    assert rows(deps, "id", "pinned", "enabled", "last_scheduled_at") == [
        ("a", True, True, dt.datetime(2026, 1, 2)), ("b", False, False, None),
    ]
    assert rows(records.dag_requirements(deps)) == [("a", "x", False, None, True), ("a", "y", True, "d", False)]
    assert rows(records.deployment_overrides(deps)) == [("a", "x", "1")]
    put(tmp_path / "t" / "deployment_id=a" / "1.json", {
        "trigger_id": "1", "deployment_id": "a", "variables": {}, "created_at": "2026-01-01 00:00:00"})
    assert rows(records.read_triggers(spark, str(tmp_path / "t")), "trigger_id", "deployment_id") == [("1", "a")]


def test_relational_rows(spark):
    runs = spark.createDataFrame(
        [("r", "g", "2026-01-01T00:00:00", None, "bad")], "run_id string, dag_id string, logical_date string, variables string, created_at string"
    )
    row = records.normalize_sql_export(runs, "dag_runs").first()
    assert row["logical_date"] == dt.datetime(2026, 1, 1) and row["variables"] == "{}" and row["created_at"] is None
    contexts = spark.createDataFrame([('{"task_id":"t","retries":2,"attempts":[{"attempt_number":1}]}',)], "context string")
    row = records.normalize_sql_export(contexts, "task_contexts").first()
    assert row["task_id"] == "t" and row["attempts"][0]["attempt_number"] == 1


DAG = """
id: etl
type: dag
owners: [ann]
default_inputs: {conn: main}
actions:
  - {id: extract, uses: py, inputs: {q: '{{ vars("table") }}'}}
  - id: load
    type: group
    upstream: [extract]
    actions:
      - {id: a, uses: py, upstream: [extract]}
      - {id: inner, type: group, actions: [{id: b, uses: py, upstream: [a], trigger_rule: all_done}]}
  - {id: clean, uses: py, teardown: extract}
---
type: variables
x: 1
---
- {id: second, actions: [{id: only, uses: py, retries: 3}]}
"""


def test_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    put(tmp_path / "dags" / "g" / "etl" / "dag.yml", DAG)
    put(tmp_path / "dags" / "g" / "etl" / "variables.yml", "table: t1\nid: not-a-dag")
    put(tmp_path / "dags" / "g" / "_draft.yml", "id: draft\nactions: [{id: z, uses: py}]")
    put(tmp_path / "dags" / "g" / "etl" / "more.yaml", "id: third\nactions: [{id: z, uses: py}]")
    put(tmp_path / "dags" / "global_variables.yml", "table: base\nn: [1, 2]")
    found = documents.read_dag_documents(spark, str(tmp_path / "dags"))
    assert rows(found, "dag_id", "task_id", "group_path", "trigger_rule") == [
        ("etl", "a", "load", "all_success"), ("etl", "b", "load/inner", "all_done"), ("etl", "clean", "", "all_success"),
        ("etl", "extract", "", "all_success"), ("second", "only", "", "all_success"), ("third", "z", "", "all_success"),
    ]
    a = found.filter("task_id = 'a'").first()
    assert (a["group_upstream"], a["owners"], json.loads(a["default_inputs"])) == (["extract"], ["ann"], {"conn": "main"})
    assert rows(G.adjacency(found)) == [("etl", "a", "b"), ("etl", "extract", "a")]
    assert rows(G.teardown_pairs(found)) == [("etl", "clean", "extract")]
    folders = aggregates.multi_dag_folders(documents.dag_files(found)).collect()
    assert [r["files"] for r in folders] == [2]

    layers = documents.read_variable_files(spark, str(tmp_path / "dags"))
    dags = documents.dag_files(found)
    seen = V.resolve_variables(layers, dags).filter("dag_id = 'etl'")
    assert rows(seen, "var_key", "var_value") == [("id", '"not-a-dag"'), ("n", "[1, 2]"), ("table", '"t1"')]


def test_fingerprint(spark, tmp_path):
    put(tmp_path / "b" / "x.yml", "one")
    put(tmp_path / "b" / "sub" / "y.yml", "three")
    manifest = documents.list_manifest(spark, f"file:{tmp_path}/b").withColumn("bundle", F.lit("b"))
    assert rows(manifest, "rel", "size_bytes") == [("sub/y.yml", 5), ("x.yml", 3)]
    fixed = spark.createDataFrame(
        [("b", "x", 3, 9), ("b", "a/y", 5, 8), ("b", "a/.z", 1, 1)], "bundle string, rel string, size_bytes long, mtime_ns long"
    )
    want = hashlib.sha256(b"a/y|5|8\nx|3|9\n").hexdigest()[:12]
    assert rows(documents.bundle_fingerprint(fixed)) == [("b", want)]


def test_logs_round_trip(spark, tmp_path):
    logs = spark.createDataFrame(
        [(1.5, "INFO", "a", "l", "task", "d1", "r1", "t1", 1, "{}", None),
         (2.5, "INFO", "b", "l", "task", "d1", "r1", "t1", 2, "{}", None),
         (3.5, "INFO", "c", "l", "task", "d1", "r1", "t1", None, "{}", None),
         (4.5, "ERROR", "d", "l", "task", "d1", None, "t1", 1, "{}", None),
         (5.5, "ERROR", "e", "l", "framework", None, None, None, None, "{}", "trace")],
        "ts double, level string, msg string, logger string, source string, dag_id string, run_id string, task_id string, attempt int, extra string, exc_info string",
    )
    out = str(tmp_path / "logs")
    sinks.write_logs(logs, out)
    folders = {str(p.parent.relative_to(out)) for p in (tmp_path / "logs").rglob("*.txt")}
    assert folders == {
        "source=task/dag_id=d1/run_id=r1/task_id=t1/attempt=1", "source=task/dag_id=d1/run_id=r1/task_id=t1/attempt=2",
        "source=framework/dag_id=__HIVE_DEFAULT_PARTITION__/run_id=__HIVE_DEFAULT_PARTITION__/"
        "task_id=__HIVE_DEFAULT_PARTITION__/attempt=__HIVE_DEFAULT_PARTITION__",
    }
    back = records.read_logs(spark, out)
    assert rows(back, "msg", "attempt", "logged_at")[0] == ("a", 1, dt.datetime(1970, 1, 1, 0, 0, 1, 500000))
    assert back.count() == 5


def test_snapshot_replaces_touched_partitions(spark, tmp_path):
    out = str(tmp_path / "snap")
    first = spark.createDataFrame([("g", 1), ("h", 2)], "dag_id string, v int")
    sinks.write_snapshot(first, out, ["dag_id"])
    sinks.write_snapshot(spark.createDataFrame([("g", 9)], "dag_id string, v int"), out, ["dag_id"])
    assert rows(spark.read.parquet(out), "dag_id", "v") == [("g", 9), ("h", 2)]


def test_alerts(spark, tmp_path):
    out = str(tmp_path / "alerts")
    sinks.write_alerts(spark.createDataFrame([("failure", "2026", "g")], "event string, timestamp string, dag_id string"), out)
    assert rows(spark.read.json(out), "event", "dag_id") == [("failure", "g")]


def test_user_functions(spark):
    def run(row):
        n = row["n"]
        if n == 1:
            raise tasks.TaskSkipped("no data")
        if n == 2:
            raise tasks.TaskFailed("for good")
        if n == 3:
            raise tasks.TaskRetry()
        if n == 4:
            raise ValueError("oops")
        if n == 5:
            raise TimeoutError("slow")
        return {0: {"rows": 1}, 6: [1, 2], 7: None}[n]

    df = spark.range(8).selectExpr("id AS n", "if(id = 7, 'gone', 'py') AS plugin_name")
    got = {r["n"]: r for r in tasks.map_tasks(df, run).collect()}
    assert [got[n]["attempt_state"] for n in range(8)] == [
        "success", "skipped", "failed", "failed", "failed", "timed_out", "success", "success",
    ]
    assert [got[n]["retry_allowed"] for n in range(8)] == [False, False, False, True, True, True, False, False]
    assert [json.loads(got[n]["outputs"]) for n in (0, 6, 7)] == [{"rows": 1}, {"_result": [1, 2]}, {}]
    assert "oops" in got[4]["error_traceback"] and got[1]["error"] == "no data"
    named = {r["n"]: r for r in tasks.map_tasks(df, {"py": lambda row: None}).collect()}
    assert named[7]["attempt_state"] == "failed" and named[7]["retry_allowed"] is False
    assert named[0]["attempt_state"] == "success"


def test_python_work_is_dealt_over_tasks(spark):
    """Rows that all lie in one partition, as a small file's do, are worked on by several tasks."""
    one = spark.range(60).coalesce(1)
    called = tasks.map_tasks(one, lambda row: row["id"])
    assert called.select(F.spark_partition_id()).distinct().count() > 1
    texts = one.selectExpr("concat('f', id) AS path", "concat('id: d', id, '\nactions: [{id: t1}]') AS text")
    parsed = documents.parse_dag_documents(texts)
    assert parsed.select(F.spark_partition_id()).distinct().count() > 1 and parsed.filter("reason IS NULL").count() == 60
