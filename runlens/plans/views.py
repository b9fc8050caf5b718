"""Run-history views over the driver's tables.

Each view is one SQL text that reads the same in Spark and in DuckDB, so a
query and its check start from the same rows. Marks stand for what the
two dialects spell differently:

    @ntz                    the timestamp type without zone
    @each(a, c, lo, hi)     one row per integer lo..hi, as a.c
    @pick(a, c, 'x', 'y')   one row per listed text, as a.c
"""

import re

from pyspark.sql import DataFrame, SparkSession

from runlens.functions.skew import unbroadcast

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # One DAG per two customers: two deployments share a DAG.
    "fx_dags": """
        SELECT DISTINCT CAST(floor(c_custkey / 2) AS BIGINT) AS dag_no,
               concat('dag-', CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)) AS dag_id
        FROM {customer}""",
    "fx_runs": """
        SELECT o_orderkey AS run_no, CAST(floor(o_custkey / 2) AS BIGINT) AS dag_no,
               concat('dag-', CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS STRING)) AS dag_id,
               concat(CASE o_orderkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'backfill'
                                          WHEN 2 THEN 'scheduled' ELSE 'legacy' END,
                      '-dag-', CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS STRING), '-',
                      CAST(o_orderkey AS STRING)) AS run_id,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE concat('dep-', CAST(o_custkey AS STRING)) END AS deployment_id,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed'
                                  ELSE 'running' END AS state,
               o_orderdate AS logical_date, o_orderkey AS created_at,
               CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS ended_at
        FROM {orders}""",
    "fx_task_events": """
        SELECT r.dag_id, r.run_id, l.l_orderkey AS run_no,
               concat('t', CAST(l.l_linenumber AS STRING)) AS task_id,
               CASE WHEN l.l_returnflag = 'A' THEN 'success'
                    WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'skipped'
                    WHEN l.l_returnflag = 'R' THEN 'upstream_failed'
                    WHEN l.l_linestatus = 'F' THEN 'failed'
                    WHEN l.l_quantity > 40 THEN 'queued'
                    WHEN l.l_quantity > 30 THEN 'up_for_retry'
                    ELSE 'running' END AS state,
               l.l_shipdate AS updated_at, l.l_partkey AS seq1, l.l_suppkey AS seq2,
               l.l_extendedprice AS seq3,
               CASE WHEN l.l_returnflag = 'A'
                    THEN concat('{{"row_count":', CAST(CAST(l.l_quantity AS BIGINT) AS STRING), '}}')
                    WHEN l.l_returnflag = 'R' THEN '[1]' ELSE '{{}}' END AS outputs
        FROM {lineitem} l JOIN {fx_runs} r ON r.run_no = l.l_orderkey""",
    "fx_task_states": """
        SELECT dag_id, run_id, run_no, task_id, state, updated_at, outputs,
               CASE WHEN seq1 % 5 = 0 THEN NULL ELSE updated_at END AS heartbeat_at
        FROM (SELECT e.*, row_number() OVER (PARTITION BY run_no, task_id
                ORDER BY updated_at DESC, seq1 DESC, seq2 DESC, seq3 DESC) AS rn
              FROM {fx_task_events} e) x
        WHERE rn = 1""",
    "fx_tasks": """
        SELECT d.dag_no, d.dag_id, concat('t', CAST(n.task_no AS STRING)) AS task_id,
               CASE (d.dag_no + n.task_no) % 10
                 WHEN 0 THEN 'all_success' WHEN 1 THEN 'all_failed' WHEN 2 THEN 'all_done'
                 WHEN 3 THEN 'all_skipped' WHEN 4 THEN 'one_success' WHEN 5 THEN 'one_failed'
                 WHEN 6 THEN 'none_failed' WHEN 7 THEN 'none_skipped'
                 WHEN 8 THEN 'none_failed_min_one_success'
                 ELSE 'none_failed_or_skipped' END AS trigger_rule,
               CASE n.task_no WHEN 2 THEN 't1' WHEN 3 THEN 't1' WHEN 4 THEN 't2,t3'
                 WHEN 5 THEN 't3' WHEN 6 THEN 't4' ELSE '' END AS upstream_list,
               CASE WHEN n.task_no = 7 THEN 't3' ELSE NULL END AS teardown,
               CASE WHEN n.task_no <> 3 THEN 'task' WHEN d.dag_no % 3 = 0 THEN 'task'
                    WHEN d.dag_no % 3 = 1 THEN 'short_circuit' ELSE 'branch' END AS type,
               CASE (d.dag_no + n.task_no) % 6 WHEN 0 THEN 'acme/loader@1.2.0'
                 WHEN 1 THEN 'unheard_of' ELSE 'py' END AS uses
        FROM {fx_dags} d @each(n, task_no, 1, 7)""",
    # The catalog with faults: lost upstreams and teardowns, repeated ids, cycles.
    "fx_plan_tasks": """
        SELECT dag_no, dag_id, task_id, upstream_list, teardown, type, uses FROM {fx_tasks}
        UNION ALL
        SELECT d.dag_no, d.dag_id,
               CASE WHEN f.fault = 'again' THEN 't2' WHEN f.fault = 'loop' THEN 't9'
                    ELSE 't8' END AS task_id,
               CASE WHEN f.fault = 'lost' THEN 't1,ghost' WHEN f.fault = 'again' THEN 't1'
                    WHEN f.fault = 'loop' THEN 't8,t9' ELSE 't6' END AS upstream_list,
               CASE WHEN f.fault = 'lost' AND d.dag_no % 2 = 0 THEN 'ghost'
                    WHEN f.fault = 'self' THEN 't8' ELSE NULL END AS teardown,
               'task' AS type, 'py' AS uses
        FROM {fx_dags} d @pick(f, fault, 'lost', 'again', 'loop', 'self')
        WHERE (f.fault = 'lost' AND d.dag_no % 7 = 3) OR (f.fault = 'again' AND d.dag_no % 5 = 2)
           OR (f.fault = 'loop' AND d.dag_no % 9 = 4) OR (f.fault = 'self' AND d.dag_no % 7 = 5)""",
    "fx_edges": """
        SELECT d.dag_id, substring(e.pair, 1, 2) AS upstream, substring(e.pair, 4, 2) AS downstream
        FROM {fx_dags} d @pick(e, pair, 't1>t2', 't1>t3', 't2>t4', 't3>t4', 't3>t5', 't4>t6')""",
    # Acyclic with diamonds: edges go up in key.
    "fx_big_edges": """
        SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS upstream, p_partkey AS downstream
        FROM {part} WHERE p_partkey >= 2
        UNION
        SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM {part} WHERE p_partkey >= 3""",
    "fx_cyclic_edges": """
        SELECT upstream, downstream FROM {fx_big_edges}
        UNION
        SELECT p_partkey, CAST(floor(p_partkey / 4) AS BIGINT) FROM {part}
        WHERE p_partkey >= 4 AND p_partkey % 97 = 0""",
    "fx_attempts": """
        SELECT conv_id AS task_no, CAST(turn AS INT) + 1 AS attempt_number,
               CASE role WHEN 'assistant' THEN 'success' WHEN 'system' THEN 'skipped'
                         ELSE 'failed' END AS state,
               CASE WHEN role = 'user' THEN concat('error at turn ', CAST(turn AS STRING))
                    ELSE NULL END AS error,
               CAST(conv_id % 4 AS INT) + 3 AS retries, 10 AS retry_delay,
               conv_id % 2 = 0 AS exponential_backoff, length(text) AS n_chars
        FROM {conversations}""",
    "fx_heartbeats": """
        SELECT user_id AS task_key, ts AS beat_at, event_id AS seq,
               CASE WHEN event_type = 'signup' THEN 'terminal' ELSE 'beat' END AS kind
        FROM {events}""",
    "fx_logs": """
        SELECT event_id AS seq, ts,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING'
                               ELSE 'INFO' END AS level,
               event_type AS msg, props AS extra, value,
               CASE WHEN user_id % 10 = 0 THEN 'framework' ELSE 'task' END AS source,
               CASE WHEN user_id % 10 = 0 THEN NULL
                    ELSE concat('dag-', CAST(user_id % 20 AS STRING)) END AS dag_id,
               CASE WHEN user_id % 10 = 0 THEN NULL
                    ELSE concat('run-', CAST(user_id AS STRING)) END AS run_id,
               CASE WHEN user_id % 10 = 0 THEN NULL
                    ELSE concat('t', CAST(event_id % 7 + 1 AS STRING)) END AS task_id,
               CASE WHEN user_id % 10 = 0 OR event_id % 4 = 0 THEN NULL
                    ELSE event_id % 4 END AS attempt
        FROM {events}""",
    # Task attempts with their time in the queue: every 97th is still open.
    "fx_spans": """
        SELECT event_id AS seq, event_type AS queue, ts AS queued_at, value AS duration,
               CASE WHEN event_id % 97 = 0 THEN NULL
                    ELSE ts + INTERVAL '1' SECOND * CAST(floor(value * 60) AS BIGINT) END AS ended_at,
               CASE WHEN event_id % 97 = 0 THEN 'running' WHEN event_type = 'error' THEN 'failed'
                    WHEN event_type = 'signup' THEN 'skipped' ELSE 'success' END AS state
        FROM {events}""",
    "fx_claims": """
        SELECT CAST(floor(event_id / 3) AS BIGINT) AS trigger_id,
               concat('inst-', CAST(user_id % 4 AS STRING)) AS instance_id,
               ts AS claimed_at, event_id AS seq
        FROM {events}""",
    "fx_tick_updates": """
        SELECT concat('dep-', CAST(o_custkey AS STRING)) AS deployment_id,
               o_orderdate AS proposed_at, o_orderkey AS arrival_seq
        FROM {orders}""",
    # Several creators per (dag, date): every line of an order is one.
    "fx_candidates": """
        SELECT r.dag_id, CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE r.logical_date END AS logical_date,
               concat('scheduled-', r.dag_id, '-', CAST(l.l_orderkey AS STRING), '-',
                      CAST(l.l_suppkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS run_id,
               l.l_shipdate AS created_at, l.l_suppkey AS instance_no,
               l.l_linenumber AS line_no, l.l_partkey AS part_no
        FROM {lineitem} l JOIN {fx_runs} r ON r.run_no = l.l_orderkey""",
    "fx_deployments": """
        SELECT concat('dep-', CAST(c_custkey AS STRING)) AS id, c_custkey AS dep_no,
               concat('dag-', CAST(CASE WHEN c_custkey % 13 = 12 THEN c_custkey + 1000000
                                        ELSE CAST(floor(c_custkey / 2) AS BIGINT) END AS STRING)) AS dag_id,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    ELSE concat('v', CAST(c_custkey % 3 AS STRING)) END AS dag_version,
               CASE c_custkey % 8 WHEN 0 THEN '0 0 * * *' WHEN 1 THEN '30 2 * * *'
                 WHEN 2 THEN '0 * * * *' WHEN 3 THEN '*/15 * * * *' WHEN 4 THEN '0 6 * * 1-5'
                 WHEN 5 THEN '0 0 1 * *' WHEN 6 THEN '15 3 1,15 * 1' ELSE NULL END AS cron,
               c_custkey % 11 <> 0 AS enabled, c_custkey % 5 = 0 AS pinned,
               c_custkey % 2 = 0 AS catch_up,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INT) END AS max_active_runs,
               CASE WHEN c_custkey % 3 = 0 THEN NULL
                    ELSE CAST('2024-01-03 00:00:00' AS @ntz) END AS last_scheduled_at,
               CASE WHEN c_custkey % 10 = 9 THEN CAST('2024-01-01 00:10:00' AS @ntz)
                    ELSE CAST('2024-01-01 00:00:00' AS @ntz) END AS start_date,
               CASE WHEN c_custkey % 6 = 5 THEN CAST('2024-01-04 12:00:00' AS @ntz)
                    ELSE NULL END AS end_date
        FROM {customer}""",
    # Deployments with aliases, six fields and rules of the calendar; kinds 13 to 15 give no ticks.
    "fx_calendar": """
        SELECT id, dep_no, dag_id, CAST(dep_no % 16 AS INT) AS kind,
               CASE dep_no % 16 WHEN 0 THEN '@daily' WHEN 1 THEN '0 0 L * *' WHEN 2 THEN '30 6 * * 5#3'
                 WHEN 3 THEN '0 12 * * L5' WHEN 4 THEN '0 9 15W * *' WHEN 5 THEN '0 9 LW * *'
                 WHEN 6 THEN '0 0 1W * *' WHEN 7 THEN '15 8 * * mon#1,wed#2' WHEN 8 THEN '*/20 6 * * 1 10,40'
                 WHEN 9 THEN '@weekly' WHEN 10 THEN '0 0 L * 5#2' WHEN 11 THEN '59 23 31 * *'
                 WHEN 12 THEN '0 0 29 2 *' WHEN 13 THEN '@reboot' WHEN 14 THEN '0 0 * * 1,5#3'
                 ELSE '61 * * * *' END AS cron,
               enabled, catch_up, max_active_runs, CAST('2024-01-01 00:00:00' AS @ntz) AS start_date,
               CAST(NULL AS @ntz) AS end_date, last_scheduled_at
        FROM {fx_deployments}""",
    "fx_catalog": """
        SELECT dag_id, concat('v', CAST(dag_no % 3 AS STRING)) AS version FROM {fx_dags}""",
    "fx_requirements": """
        SELECT d.id AS deployment_id, k.var_key, k.var_key = 'v2' AS has_default,
               d.pinned AND k.var_key = 'v1' AS overridden
        FROM {fx_deployments} d @pick(k, var_key, 'v0', 'v1', 'v2')""",
    "fx_triggers": """
        SELECT o_orderkey AS trigger_id,
               concat('dep-', CAST(o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1000000 ELSE 0 END
                                   AS STRING)) AS deployment_id,
               CASE o_orderkey % 3 WHEN 0 THEN '{{"v0":"a","v1":"b"}}' WHEN 1 THEN '{{"v0":"a"}}'
                                   ELSE '{{}}' END AS variables,
               o_orderdate AS created_at
        FROM {orders}""",
    "fx_variable_layers": """
        SELECT DISTINCT 1 AS depth, 'dags' AS scope, k.var_key, 'bundle' AS var_value
        FROM {region} @pick(k, var_key, 'v0', 'v1', 'v2', 'v3', 'v4')
        UNION ALL
        SELECT 2, concat('dags/', r_name), k.var_key, concat('region:', r_name)
        FROM {region} @pick(k, var_key, 'v0', 'v1', 'v2')
        WHERE (r_regionkey + CAST(substring(k.var_key, 2, 1) AS INT)) % 2 = 0
        UNION ALL
        SELECT 3, concat('dags/', r_name, '/', n_name), k.var_key, concat('nation:', n_name)
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey @pick(k, var_key, 'v0', 'v1', 'v2')
        WHERE (n_nationkey + CAST(substring(k.var_key, 2, 1) AS INT)) % 3 = 0
        UNION ALL
        SELECT 4, concat('dags/', r_name, '/', n_name, '/c', CAST(c_custkey AS STRING)), 'v1', c_mktsegment
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey WHERE c_acctbal > 5000""",
    "fx_variable_dags": """
        SELECT concat('dag-', CAST(c_custkey AS STRING)) AS dag_id,
               concat('dags/', r_name, '/', n_name, '/c', CAST(c_custkey AS STRING)) AS folder
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey""",
    "fx_inputs": """
        SELECT p_partkey AS task_no, 'target' AS input_key,
               concat('{{{{ vars("v', CAST(p_size % 6 AS STRING), '") }}}}/', p_name,
                      CASE WHEN p_partkey % 2 = 0 THEN '/{{{{ vars("v9", "none") }}}}' ELSE '' END,
                      CASE WHEN p_partkey % 3 = 0
                           THEN concat('/{{{{ secrets("KEY_', CAST(p_size AS STRING), '") }}}}')
                           ELSE '' END) AS template
        FROM {part}""",
    "fx_results": """
        SELECT r.run_no, r.dag_id, r.run_id, 't3' AS task_id,
               CASE r.dag_no % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'short_circuit' ELSE 'branch' END AS task_type,
               CASE r.run_no % 10 WHEN 0 THEN '{{"_result":true}}' WHEN 1 THEN '{{"_result":false}}'
                 WHEN 2 THEN '{{"_result":["t4"]}}' WHEN 3 THEN '{{"_result":"t5"}}'
                 WHEN 4 THEN '{{"branch":["t4","t5"]}}' WHEN 5 THEN '{{"continue":false}}'
                 WHEN 6 THEN '{{"rows":3}}' WHEN 7 THEN '{{"_result":7}}'
                 WHEN 8 THEN '{{"_result":0}}' ELSE '{{}}' END AS raw_outputs
        FROM {fx_runs} r""",
    # Record files as text, with some that cannot be read: every 50th of each kind.
    "fx_run_texts": """
        SELECT run_no, concat('dag_runs/', CAST(run_no AS STRING), '.json') AS path,
               CASE run_no % 50 WHEN 7 THEN NULL WHEN 8 THEN '{{"run_id": "cut' WHEN 9 THEN '[1, 2]'
                 WHEN 10 THEN concat('{{"run_id":"', run_id, '","dag_id":"', dag_id, '","created_at":"soon"}}')
                 ELSE concat('{{"run_id":"', run_id, '","dag_id":"', dag_id, '","state":"', state, '","logical_date":"',
                             CAST(logical_date AS STRING), '","variables":{{"n":', CAST(run_no % 5 AS STRING), '}},"ended_at":null}}') END AS text
        FROM {fx_runs}""",
    "fx_state_texts": """
        SELECT concat('task_states/', run_id, '/', task_id, '.json') AS path,
               CASE WHEN run_no % 50 = 8 THEN '{{"state":' ELSE concat('{{"run_id":"', run_id, '","dag_id":"', dag_id, '","task_id":"',
                 task_id, '","state":"', state, '","updated_at":"', CAST(updated_at AS STRING), '"}}') END AS text
        FROM {fx_task_states}""",
    "fx_context_texts": """
        SELECT concat('contexts/', CAST(task_no AS STRING), '/', CAST(attempt_number AS STRING), '.json') AS path,
               CASE WHEN task_no % 50 = 8 THEN 'no json' ELSE concat('{{"run_id":"r', CAST(task_no AS STRING), '","dag_id":"d","task_id":"t',
                 CAST(attempt_number AS STRING), '","retries":', CAST(retries AS STRING), ',"attempts":[{{"attempt_number":',
                 CAST(attempt_number AS STRING), ',"state":"', state, '","duration_sec":1.5}}]}}') END AS text
        FROM {fx_attempts}""",
    "fx_deployment_texts": """
        SELECT concat('deployments/', id, '.json') AS path,
               CASE dep_no % 50 WHEN 8 THEN '' WHEN 9 THEN concat('{{"id":"', id, '","max_active_runs":"many"}}')
                 ELSE concat('{{"id":"', id, '","dag_id":"', dag_id, '","cron":', CASE WHEN cron IS NULL THEN 'null' ELSE concat('"', cron, '"') END,
                   CASE WHEN pinned THEN ',"variable_overrides":{{"v1": 2}}' ELSE '' END,
                   CASE WHEN last_scheduled_at IS NULL THEN '' ELSE ',"_scheduler":{{"last_scheduled_at":"2024-01-03T00:00:00"}}' END, '}}') END AS text
        FROM {fx_deployments}""",
    "fx_trigger_texts": """
        SELECT concat('triggers/', CAST(trigger_id AS STRING), '.json') AS path,
               CASE WHEN trigger_id % 50 = 8 THEN '17' ELSE concat('{{"trigger_id":"', CAST(trigger_id AS STRING), '","deployment_id":"',
                 deployment_id, '","variables":', variables, ',"created_at":"', CAST(created_at AS STRING), '"}}') END AS text
        FROM {fx_triggers}""",
    "fx_log_texts": """
        SELECT concat('logs/', source, '.jsonl') AS path, seq,
               CASE WHEN seq % 50 = 8 THEN concat('Traceback ', CAST(seq AS STRING)) ELSE concat('{{"ts":', CAST(1704067200 + seq AS STRING), '.25,"level":"', level,
                 '","msg":"', msg, '","source":"', source, '","attempt":', CASE WHEN attempt IS NULL THEN 'null' ELSE CAST(attempt AS STRING) END,
                 ',"extra":', extra, '}}') END AS text
        FROM {fx_logs}""",
    # A DAG document each, some broken in their own ways.
    "fx_dag_texts": """
        SELECT dag_no, concat('bundle/', dag_id, '.yml') AS path,
               CASE dag_no % 10 WHEN 3 THEN 'id: [' WHEN 4 THEN 'actions: [{{id: t1}}]'
                 WHEN 5 THEN concat('id: ', dag_id, '\nactions: [{{id: t1}}, {{uses: py}}]')
                 WHEN 6 THEN concat('id: ', dag_id, '\nactions: [{{id: t1, retries: 2}}]\n---\nid: [')
                 WHEN 7 THEN 'type: variables\nx: 1' WHEN 8 THEN NULL
                 ELSE concat('id: ', dag_id, '\nactions:\n- {{id: t1, uses: py}}\n- id: g\n  upstream: [t1]\n  actions:\n',
                             '  - {{id: t2, upstream: [t1]}}\n  - {{id: h, actions: [{{id: t3, inputs: {{n: 1}}}}]}}\n') END AS text,
               concat('[{{"id":"t1"}},{{"id":"g","actions":[{{"id":"t2","type":"branch"}},{{"id":"h","actions":[{{"id":"t3"}}]}},',
                      '{{"id":"e","actions":[]}}]}}]') AS actions, dag_id
        FROM {fx_dags}""",
    "fx_variable_texts": """
        SELECT concat('dags/d', CAST(dag_no AS STRING), CASE WHEN dag_no % 2 = 0 THEN '/variables.yml' ELSE '/global_variables.yml' END) AS path,
               dag_no, CASE dag_no % 10 WHEN 3 THEN 'a: {{' WHEN 4 THEN '- a list' WHEN 5 THEN '' WHEN 6 THEN NULL
                 ELSE concat('v0: ', CAST(dag_no AS STRING), '\nv1: [a, 2]\nv2: "3"\n') END AS text
        FROM {fx_dags}""",
    # A list of items for one task of each run, and the outputs of some of its instances.
    "fx_foreach": """
        SELECT run_no, dag_id, run_id, 't1' AS task_id,
               CASE run_no % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["a"]' WHEN 3 THEN '["a", null, {{"k": 2}}]'
                 WHEN 4 THEN '{{"a": 1}}' ELSE concat('[', CAST(run_no AS STRING), ', "b c"]') END AS items,
               CASE run_no % 6 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 5 THEN 2 END AS n_items
        FROM {fx_runs}""",
    "fx_foreach_outputs": """
        SELECT f.run_no, f.dag_id, f.run_id, f.task_id, i.item_index, concat('{{"i":', CAST(i.item_index AS STRING), '}}') AS output,
               CASE (f.run_no + i.item_index) % 7 WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'success' END AS state
        FROM {fx_foreach} f @each(i, item_index, 0, 3)
        WHERE i.item_index < coalesce(f.n_items, 0) + 1 AND (f.run_no + i.item_index) % 5 <> 0""",
    "fx_manifest": """
        SELECT page_id % 10 AS bundle_no,
               CASE WHEN page_id % 6 = 0 THEN concat(url, '/.hidden') ELSE url END AS rel,
               length(html) AS size_bytes, page_id AS mtime_ns FROM {pages}""",
    "fx_text": """
        SELECT p_partkey AS id,
               concat('k1=', p_brand, ';k2 =', p_type,
                      CASE WHEN p_partkey % 7 = 0 THEN ';bad' ELSE ';k1=z' END) AS kv,
               concat('getHTTP', CASE p_partkey % 3 WHEN 0 THEN 'ResponseCode' WHEN 1 THEN '2Code'
                                 ELSE 'XYZ' END, replace(p_brand, '#', 'No')) AS ident,
               CASE p_partkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'my-org/gcs-plugin@1.2.0'
                 WHEN 2 THEN concat('gcs-tool@2.0.', CAST(p_size AS STRING)) ELSE 'bad ref@' END AS uses,
               CASE p_partkey % 3 WHEN 0 THEN '2026-06-06T10:30:45' WHEN 1 THEN '2026-06-06 10:30:45'
                 ELSE 'soon' END AS ts_text,
               CASE WHEN p_partkey % 13 < 6 THEN CAST(p_partkey % 13 AS INT) ELSE NULL END AS exit_code,
               CASE p_partkey % 13 WHEN 6 THEN 'TaskSkipped' WHEN 7 THEN 'TaskFailed'
                 WHEN 8 THEN 'TaskRetry' WHEN 9 THEN 'TimeoutError' WHEN 10 THEN 'NotImplementedError'
                 WHEN 11 THEN 'ValueError' ELSE NULL END AS exception
        FROM {part}""",
    "fx_lines": """
        SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS channel
        FROM {documents}""",
}

#: Views that grow with the history. A text that joins one shuffles it: its rows are many times the file that Spark judges
#: it by, and a broadcast would bring them all through the driver.
GROWING = ("fx_runs",)

_EACH = re.compile(r"@each\((\w+), (\w+), (\d+), (\d+)\)")
_PICK = re.compile(r"@pick\((\w+), (\w+), ([^)]*)\)")


def needs(sql: str) -> list[str]:
    """Tables and views a text refers to."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def for_spark(sql: str) -> str:
    sql = _EACH.sub(r"LATERAL VIEW explode(sequence(\3, \4)) \1 AS \2", sql)
    sql = _PICK.sub(r"LATERAL VIEW explode(array(\3)) \1 AS \2", sql)
    return sql.replace("@ntz", "TIMESTAMP_NTZ")


def for_duckdb(sql: str) -> str:
    sql = _EACH.sub(r"CROSS JOIN unnest(range(\3, \4 + 1)) AS \1(\2)", sql)
    sql = _PICK.sub(r"CROSS JOIN unnest([\3]) AS \1(\2)", sql)
    return sql.replace("@ntz", "TIMESTAMP")


class History:
    """The tables of one folder and the views over them, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._frames[name] = self.sql(VIEWS[name])
        return self._frames[name]

    def sql(self, text: str) -> DataFrame:
        frames = {name: getattr(self, name) for name in needs(text)}
        for name in GROWING:
            if f"JOIN {{{name}}}" in text:
                frames[name] = unbroadcast(frames[name])
        return self.spark.sql(for_spark(text), **frames)


def check_sql(text: str) -> str:
    """A check's SQL with the views it needs as common table expressions.

    In `text` views and tables appear as {name}.
    """
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in needs(sql):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(text)

    def plain(sql: str) -> str:
        return for_duckdb(sql).format(**{name: name for name in needs(sql)})

    body = plain(text).strip()
    if not order:
        return body
    ctes = [f"{name} AS ({plain(VIEWS[name])})" for name in order]
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + re.sub(r"^WITH\s+RECURSIVE\s+", "", body, flags=re.I)
    if re.match(r"WITH\s", body, re.I):
        return "WITH " + ", ".join(ctes) + ", " + re.sub(r"^WITH\s+", "", body, flags=re.I)
    return "WITH " + ", ".join(ctes) + " " + body
