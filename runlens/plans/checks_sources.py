"""Queries over records and documents held as text, items of foreach tasks, and retention."""

from pyspark.sql import functions as F

from runlens.operators import foreach, graph, retention, tasks
from runlens.plans.checks import check, moment
from runlens.sources import documents, records


@check("io1_run_records", """
    SELECT path, CASE WHEN n IN (7, 8, 9) THEN NULL ELSE run_id END AS run_id, CASE WHEN n IN (7, 8, 9, 10) THEN NULL ELSE state END AS state,
           CASE WHEN n IN (7, 8, 9, 10) THEN NULL ELSE logical_date END AS logical_date,
           CASE WHEN n IN (7, 8, 9, 10) THEN NULL ELSE '{{"n":' || (run_no % 5) || '}}' END AS variables,
           CASE n WHEN 7 THEN 'no_text' WHEN 8 THEN 'not_json' WHEN 9 THEN 'not_json' WHEN 10 THEN 'bad_value' END AS reason
    FROM (SELECT r.*, t.path, r.run_no % 50 AS n FROM {fx_runs} r JOIN {fx_run_texts} t USING (run_no))""")
def _(h):
    return records.shape_records(h.fx_run_texts, "dag_runs").select("path", "run_id", "state", "logical_date", "variables", "reason")


@check("io1_run_record_errors", """
    SELECT path, CASE run_no % 50 WHEN 7 THEN 'no_text' WHEN 10 THEN 'bad_value' ELSE 'not_json' END AS reason
    FROM {fx_run_texts} WHERE run_no % 50 BETWEEN 7 AND 10""")
def _(h):
    return records.records_and_errors(records.shape_records(h.fx_run_texts, "dag_runs"))[1]


@check("io2_state_records", """
    SELECT run_id, task_id, state, updated_at, CAST(NULL AS VARCHAR) AS reason FROM {fx_task_states} WHERE run_no % 50 <> 8
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'not_json' FROM {fx_task_states} WHERE run_no % 50 = 8""")
def _(h):
    return records.shape_records(h.fx_state_texts, "task_states").select("run_id", "task_id", "state", "updated_at", "reason")


@check("io3_attempt_records", """
    SELECT 'r' || task_no AS run_id, 't' || attempt_number AS task_id, attempt_number, state, 1.5::DOUBLE AS duration_sec
    FROM {fx_attempts} WHERE task_no % 50 <> 8""")
def _(h):
    contexts, _ = records.records_and_errors(records.shape_records(h.fx_context_texts, "task_contexts"))
    return records.explode_attempts(contexts).select("run_id", "task_id", "attempt_number", "state", "duration_sec")


@check("io4_deployment_records", """
    SELECT CASE WHEN n = 8 THEN NULL ELSE id END AS id, CASE WHEN n IN (8, 9) THEN NULL ELSE dag_id END AS dag_id,
           CASE WHEN n IN (8, 9) THEN NULL ELSE cron END AS cron, true AS enabled, false AS catch_up,
           n NOT IN (8, 9) AND pinned AS pinned, CASE WHEN n IN (8, 9) THEN NULL ELSE last_scheduled_at END AS last_scheduled_at,
           CASE n WHEN 8 THEN 'not_json' WHEN 9 THEN 'bad_value' END AS reason
    FROM (SELECT *, dep_no % 50 AS n FROM {fx_deployments})""")
def _(h):
    return records.shape_records(h.fx_deployment_texts, "deployments").select(
        "id", "dag_id", "cron", "enabled", "catch_up", "pinned", "last_scheduled_at", "reason"
    )


@check("io5_trigger_records", """
    SELECT CAST(trigger_id AS VARCHAR) AS trigger_id, deployment_id, variables, created_at, CAST(NULL AS VARCHAR) AS reason
    FROM {fx_triggers} WHERE trigger_id % 50 <> 8
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'not_json' FROM {fx_triggers} WHERE trigger_id % 50 = 8""")
def _(h):
    return records.shape_records(h.fx_trigger_texts, "triggers").select("trigger_id", "deployment_id", "variables", "created_at", "reason")


@check("io6_log_records", """
    SELECT level, msg, source, attempt::INTEGER AS attempt, replace(extra, ' ', '') AS extra,
           make_timestamp((1704067200 + seq) * 1000000 + 250000) AS logged_at FROM {fx_logs} WHERE seq % 50 <> 8""")
def _(h):
    logs, _ = records.records_and_errors(records.shape_records(h.fx_log_texts, "logs"))
    return logs.select("level", "msg", "source", "attempt", "extra", "logged_at")


@check("io6_log_record_errors", """
    SELECT path, 'not_json' AS reason, count(*) AS lines FROM {fx_log_texts} WHERE seq % 50 = 8 GROUP BY path""")
def _(h):
    errors = records.records_and_errors(records.shape_records(h.fx_log_texts, "logs"))[1]
    return errors.groupBy("path", "reason").agg(F.count(F.lit(1)).alias("lines"))


@check("io8_dag_documents", """
    SELECT path, dag_id, t.task_id, t.group_path, t.position, CAST(NULL AS VARCHAR) AS reason FROM {fx_dag_texts},
        (VALUES ('t1', '', 0), ('t2', 'g', 1), ('t3', 'g/h', 2)) t(task_id, group_path, position) WHERE dag_no % 10 IN (0, 1, 2, 9)
    UNION ALL SELECT path, dag_id, 't1', '', 0, NULL FROM {fx_dag_texts} WHERE dag_no % 10 = 6
    UNION ALL SELECT path, NULL, NULL, NULL, NULL, CASE dag_no % 10 WHEN 4 THEN 'no_dag_id' WHEN 5 THEN 'bad_action'
        WHEN 8 THEN 'not_text' ELSE 'not_yaml' END FROM {fx_dag_texts} WHERE dag_no % 10 IN (3, 4, 5, 6, 8)""")
def _(h):
    parsed = documents.parse_dag_documents(h.fx_dag_texts)
    return parsed.select(F.col("bundle_path").alias("path"), "dag_id", "task_id", "group_path", "position", "reason")


@check("io9_variable_documents", """
    SELECT path, 'dags/d' || dag_no AS scope, 2 AS depth, dag_no % 2 = 0 AS is_dag_scope, v.var_key,
           coalesce(v.var_value, CAST(dag_no AS VARCHAR)) AS var_value, CAST(NULL AS VARCHAR) AS reason
    FROM {fx_variable_texts}, (VALUES ('v0', NULL), ('v1', '["a", 2]'), ('v2', '"3"')) v(var_key, var_value)
    WHERE dag_no % 10 NOT IN (3, 4, 5, 6)
    UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, CASE dag_no % 10 WHEN 3 THEN 'not_yaml' WHEN 4 THEN 'not_a_mapping' ELSE 'not_text' END
    FROM {fx_variable_texts} WHERE dag_no % 10 IN (3, 4, 6)""")
def _(h):
    return documents.parse_variable_documents(h.fx_variable_texts).select(
        "path", "scope", "depth", "is_dag_scope", "var_key", "var_value", "reason"
    )


@check("gr1_flatten_groups", """
    SELECT dag_id, t.task_id, t.type, t.group_path FROM {fx_dag_texts},
        (VALUES ('t1', NULL, ''), ('t2', 'branch', 'g'), ('t3', NULL, 'g/h'), ('e', NULL, 'g')) t(task_id, type, group_path)""")
def _(h):
    return graph.flatten_group_rows(h.fx_dag_texts.select("dag_id", "actions")).drop("action")


@check("uf1_map_tasks", """
    SELECT id, CASE uses WHEN 'py' THEN 'success' WHEN 'bad ref@' THEN 'skipped' ELSE 'failed' END AS attempt_state,
           CASE uses WHEN 'py' THEN '{{"_result": ' || id || '}}' ELSE '{{}}' END AS outputs,
           uses <> 'py' AND uses <> 'bad ref@' AND uses = 'my-org/gcs-plugin@1.2.0' AS retry_allowed
    FROM {fx_text}""")
def _(h):
    """A plugin that answers, one that skips, one that fails and may be tried again; the others are not registered."""

    def skip(row):
        raise tasks.TaskSkipped()

    def fail(row):
        raise ValueError(row["id"])

    plugins = {"py": lambda row: row["id"], "bad ref@": skip, "my-org/gcs-plugin@1.2.0": fail}
    called = tasks.map_tasks(h.fx_text.select("id", F.col("uses").alias("plugin_name")), plugins)
    return called.select("id", "attempt_state", "outputs", "retry_allowed")


_ITEM = """CASE run_no % 6 WHEN 2 THEN 'a' WHEN 3 THEN CASE i WHEN 0 THEN 'a' WHEN 2 THEN '{{"k":2}}' END
    WHEN 5 THEN CASE i WHEN 0 THEN CAST(run_no AS VARCHAR) ELSE 'b c' END END"""


@check("opt4_expand_foreach", f"""
    SELECT run_id, task_id, CAST(i AS INTEGER) AS item_index, task_id || '[' || i || ']' AS instance_id, {_ITEM} AS item
    FROM {{fx_foreach}}, (SELECT unnest([0, 1, 2]) AS i) WHERE i < n_items""")
def _(h):
    return foreach.expand_foreach(h.fx_foreach).drop("dag_id")


@check("opt4_foreach_problems", """
    SELECT run_id, CASE WHEN items IS NULL THEN 'no_items' ELSE 'not_a_list' END AS problem FROM {fx_foreach} WHERE run_no % 6 IN (0, 4)""")
def _(h):
    return foreach.foreach_problems(h.fx_foreach).select("run_id", "problem")


@check("opt4_foreach_outputs", """
    WITH lists AS (SELECT dag_id, run_id, list_transform(range(0, n_items), lambda i:
        CASE WHEN (run_no + i) % 5 <> 0 THEN '{{"i":' || i || '}}' END) AS outputs FROM {fx_foreach} WHERE n_items IS NOT NULL)
    SELECT run_id, e.downstream AS task_id, array_to_string(list_transform(outputs, lambda o: coalesce(o, 'null')), ';') AS outputs
    FROM lists JOIN {fx_edges} e ON e.dag_id = lists.dag_id AND e.upstream = 't1'""")
def _(h):
    lists = foreach.downstream_lists(foreach.gather_outputs(h.fx_foreach, h.fx_foreach_outputs), h.fx_edges)
    return lists.select("run_id", "task_id", F.array_join("outputs", ";", "null").alias("outputs"))


@check("opt4_foreach_states", """
    WITH s AS (SELECT f.run_id, f.n_items, count(o.state) AS ended, count(*) FILTER (o.state = 'failed') AS broken,
                      count(*) FILTER (o.state = 'skipped') AS skipped
               FROM {fx_foreach} f LEFT JOIN {fx_foreach_outputs} o ON o.run_id = f.run_id AND o.item_index < f.n_items
               WHERE f.n_items IS NOT NULL GROUP BY ALL)
    SELECT run_id, CASE WHEN n_items = 0 THEN 'skipped' WHEN ended < n_items THEN 'running' WHEN broken > 0 THEN 'failed'
                        WHEN skipped = n_items THEN 'skipped' ELSE 'success' END AS state FROM s""")
def _(h):
    own = h.fx_foreach_outputs.join(foreach.expand_foreach(h.fx_foreach), ["dag_id", "run_id", "task_id", "item_index"], "left_semi")
    return foreach.foreach_states(h.fx_foreach, own).select("run_id", "state")


PURGE_AT, KEEP_DAYS = "2001-01-01 00:00:00", 400


@check("opt1_purge_plan", f"""
    WITH r AS (SELECT dag_id, state IN ('success', 'failed') AND ended_at < TIMESTAMP '{PURGE_AT}' - INTERVAL {KEEP_DAYS} DAY AS gone FROM {{fx_runs}}),
    c AS (SELECT dag_id, count(*) FILTER (gone) AS purged, count(*) - count(*) FILTER (gone) AS kept FROM r GROUP BY dag_id)
    SELECT *, CASE WHEN purged = 0 THEN 'keep' WHEN kept = 0 THEN 'drop' ELSE 'rewrite' END AS action FROM c""")
def _(h):
    return retention.purge_plan(h.fx_runs, ["dag_id"], retention.run_expired(moment(PURGE_AT), KEEP_DAYS))


@check("opt1_purged_records", f"""
    SELECT s.run_id, s.task_id FROM {{fx_task_states}} s JOIN {{fx_runs}} r USING (dag_id, run_id)
    WHERE NOT coalesce(r.state IN ('success', 'failed') AND r.ended_at < TIMESTAMP '{PURGE_AT}' - INTERVAL {KEEP_DAYS} DAY, false)""")
def _(h):
    gone = retention.purge_runs(h.fx_runs, moment(PURGE_AT), KEEP_DAYS)
    return retention.purge_records(h.fx_task_states, gone).select("run_id", "task_id")


@check("opt3_expire_plan", """
    SELECT CAST(ts AS DATE) AS day, count(*) AS lines, CAST(ts AS DATE) < DATE '2024-01-31' - 14 AS expired
    FROM {fx_logs} WHERE ts IS NOT NULL GROUP BY 1, 3""")
def _(h):
    return retention.expire_plan(h.fx_logs, moment("2024-01-31 09:00:00"), 14)
