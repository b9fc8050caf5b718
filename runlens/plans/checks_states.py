"""Queries over filters, states, rules, aggregates and windows."""

from pyspark.sql import functions as F

from runlens.functions import maps, states, text
from runlens.operators import aggregates, filters, ordering, rules, sets, windows
from runlens.operators import graph as G
from runlens.plans.checks import big, catalog, check, contexts, listed
from runlens.values import OBSERVED_TRANSITIONS

TERMINAL = "('success','failed','skipped','upstream_failed','removed')"


@check("fp1_lookup", """
    SELECT run_id, dag_id, state, logical_date FROM {fx_runs}
    WHERE dag_id = 'dag-7' AND state = 'failed'""")
def _(h):
    return filters.lookup(h.fx_runs, dag_id="dag-7", state="failed").select(
        "run_id", "dag_id", "state", "logical_date"
    )


@check("fp2_active_runs", """
    SELECT run_id, dag_id, deployment_id, logical_date FROM {fx_runs} WHERE state = 'running'""")
def _(h):
    return filters.active_runs(h.fx_runs).select("run_id", "dag_id", "deployment_id", "logical_date")


@check("fp3_terminal_states", f"""
    SELECT run_id, task_id, state, state IN {TERMINAL} AS is_terminal FROM {{fx_task_states}}""")
def _(h):
    return filters.with_terminal(h.fx_task_states).select("run_id", "task_id", "state", "is_terminal")


@check("fp4_run_trigger", """
    SELECT run_id, CASE WHEN split_part(run_id, '-', 1) IN ('manual','backfill','scheduled')
                        THEN split_part(run_id, '-', 1) ELSE 'unknown' END AS run_trigger
    FROM {fx_runs}""")
def _(h):
    return filters.with_run_trigger(h.fx_runs).select("run_id", "run_trigger")


@check("fp5_make_run_id", """
    SELECT run_no, CASE run_no % 4
        WHEN 0 THEN 'manual-' || dag_id || '-' || substr(sha256(dag_id || '|' || CAST(run_no AS VARCHAR)), 1, 24)
        WHEN 1 THEN 'backfill-' || dag_id || '-' || strftime(logical_date, '%Y%m%dT%H%M%S')
        ELSE 'scheduled-' || dag_id || '-' || strftime(logical_date, '%Y%m%dT%H%M%S') END AS run_id
    FROM {fx_runs}""")
def _(h):
    kind = F.expr(
        "CASE run_no % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'backfill' "
        "WHEN 2 THEN 'scheduled' ELSE 'recovered' END"
    )
    named = filters.with_run_id(h.fx_runs.drop("run_id"), kind, F.col("run_no"))
    return named.select("run_no", "run_id")


@check("fp6_task_outputs", """
    SELECT dag_id, run_id, task_id,
           CASE WHEN outputs LIKE '{{%' THEN outputs ELSE '{{}}' END AS outputs
    FROM {fx_task_states}""")
def _(h):
    return filters.task_outputs(h.fx_task_states)


@check("fp7_retry_policy", """
    SELECT task_no, count(*) AS attempt_number, count(*) <= retries AS has_retries_left,
           CASE WHEN exponential_backoff THEN CAST(retry_delay * 2 ** (count(*) - 1) AS DOUBLE)
                ELSE CAST(retry_delay AS DOUBLE) END AS next_retry_delay
    FROM {fx_attempts} GROUP BY task_no, retries, retry_delay, exponential_backoff""")
def _(h):
    return filters.retry_policy(contexts(h)).select(
        "task_no", big("attempt_number"), "has_retries_left", "next_retry_delay"
    )


@check("fp8_attempt_duration", """
    SELECT e.run_id, e.task_id, e.seq1, e.seq2, e.seq3,
           epoch_us(e.updated_at) / 1e6 - epoch_us(r.logical_date) / 1e6 AS duration_sec
    FROM {fx_task_events} e JOIN {fx_runs} r USING (run_no)""")
def _(h):
    attempts = h.fx_task_events.join(
        h.fx_runs.select("run_no", F.col("logical_date").alias("started_at")), "run_no"
    ).withColumnRenamed("updated_at", "ended_at")
    return filters.attempt_duration(attempts).select(
        "run_id", "task_id", "seq1", "seq2", "seq3", "duration_sec"
    )


@check("fp9_parse_timestamp", """
    SELECT id, TRY_CAST(ts_text AS TIMESTAMP) AS parsed_at FROM {fx_text}""")
def _(h):
    return h.fx_text.select("id", states.parse_timestamp(F.col("ts_text")).alias("parsed_at"))


@check("fp10_parse_kv", """
    WITH items AS (SELECT id, unnest(split(kv, ';')) AS item, generate_subscripts(split(kv, ';'), 1) AS pos FROM {fx_text}),
    good AS (SELECT id, trim(split_part(item, '=', 1)) AS k, arg_max(substr(item, strpos(item, '=') + 1), pos) AS v
             FROM items WHERE item LIKE '%=%' GROUP BY 1, 2),
    packed AS (SELECT id, '{{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}}' AS vars FROM good GROUP BY id),
    bad AS (SELECT id, count(*) AS bad_items FROM items WHERE item NOT LIKE '%=%' GROUP BY id)
    SELECT t.id, p.vars, coalesce(b.bad_items, 0) AS bad_items
    FROM {fx_text} t LEFT JOIN packed p USING (id) LEFT JOIN bad b USING (id)""")
def _(h):
    items = F.split("kv", ";")
    return h.fx_text.select(
        "id", maps.sorted_json(text.parse_kv(items)).alias("vars"),
        F.size(text.bad_kv(items)).cast("long").alias("bad_items"),
    )


@check("fp11_snake_case", r"""
    SELECT id, lower(regexp_replace(regexp_replace(ident, '(.)([A-Z][a-z]+)', '\1_\2', 'g'),
                                    '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake
    FROM {fx_text}""")
def _(h):
    return h.fx_text.select("id", text.snake_case(F.col("ident")).alias("snake"))


@check("fp12_has_template", """
    SELECT task_no, contains(template, 'secrets') AS plain, TRUE AS is_template FROM {fx_inputs}
    UNION ALL SELECT doc_id, FALSE,
        regexp_matches(text, '(?s)\\{{\\{{.*?\\}}\\}}|\\{{%.*?%\\}}|\\{{#.*?#\\}}') FROM {documents}""")
def _(h):
    inputs = h.fx_inputs.select(
        "task_no", F.col("template").contains("secrets").alias("plain"),
        text.has_template(F.col("template")).alias("is_template"),
    )
    return inputs.unionByName(h.documents.select(
        F.col("doc_id").alias("task_no"), F.lit(False).alias("plain"),
        text.has_template(F.col("text")).alias("is_template"),
    ))


@check("fp13_row_fingerprint", """
    SELECT id, sha256('{{"id":' || id || ',"kv":"' || kv || '","ident":"' || ident || '"}}') AS fingerprint
    FROM {fx_text}""")
def _(h):
    return filters.row_fingerprint(h.fx_text, ["id", "kv", "ident"]).select("id", "fingerprint")


@check("fp14_route_by_hour", """
    SELECT seq, hour(beat_at) IN (0, 6, 12, 18) AS takes_success FROM {fx_heartbeats}""")
def _(h):
    beats = h.fx_heartbeats.withColumnRenamed("beat_at", "logical_date")
    return filters.route_by_hour(beats, [0, 6, 12, 18]).select("seq", "takes_success")


@check("fp15_plugin_ref", r"""
    WITH r AS (SELECT id, uses, regexp_matches(uses,
        '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?(/[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?)?@[a-zA-Z0-9][a-zA-Z0-9._+\-]*$') AS remote,
        split_part(uses, '@', 1) AS n, split_part(uses, '@', 2) AS v FROM {fx_text})
    SELECT id, CASE WHEN NOT remote THEN 'local' WHEN n LIKE '%/%' THEN 'repository' ELSE 'package' END AS ref_kind,
           CASE WHEN remote THEN n ELSE uses END AS ref_name, CASE WHEN remote THEN v END AS ref_version,
           CASE WHEN remote AND n LIKE '%/%' THEN 'git+https://github.com/' || n || '@' || v
                WHEN remote THEN n || '==' || v END AS install_spec
    FROM r""")
def _(h):
    return filters.classify_plugin_ref(h.fx_text).select(
        "id", "ref_kind", "ref_name", "ref_version", "install_spec"
    )


@check("fp16_classify_outcome", """
    SELECT id,
      CASE WHEN exit_code IS NOT NULL THEN CASE exit_code WHEN 0 THEN 'success' WHEN 3 THEN 'skipped' ELSE 'failed' END
           WHEN exception IS NULL THEN 'success' WHEN exception = 'TaskSkipped' THEN 'skipped'
           WHEN exception = 'TimeoutError' THEN 'timed_out' ELSE 'failed' END AS attempt_state,
      CASE WHEN exit_code IS NOT NULL THEN exit_code IN (1, 4, 5)
           ELSE coalesce(exception IN ('TaskRetry', 'TimeoutError', 'ValueError'), FALSE) END AS retry_allowed
    FROM {fx_text}""")
def _(h):
    return filters.classify_outcome(h.fx_text).select("id", "attempt_state", "retry_allowed")


@check("fp17_final_state", """
    WITH t AS (SELECT task_no, retries, retry_delay, exponential_backoff, count(*) AS n,
                      arg_max(state, attempt_number) AS last FROM {fx_attempts} GROUP BY ALL),
    s AS (SELECT *, CASE WHEN last IN ('success', 'skipped') THEN last WHEN n <= retries THEN 'up_for_retry'
                         ELSE 'failed' END AS final_state FROM t)
    SELECT task_no, final_state, CASE WHEN final_state = 'up_for_retry' THEN
        CASE WHEN exponential_backoff THEN retry_delay * 2.0 ** (n - 1) ELSE retry_delay END END AS retry_delay_sec
    FROM (SELECT task_no, final_state, n, exponential_backoff, CAST(retry_delay AS DOUBLE) AS retry_delay FROM s)""")
def _(h):
    return filters.final_state(contexts(h)).select("task_no", "final_state", "retry_delay_sec")


@check("fp18_validate_deployments", """
    WITH d AS (SELECT id, dag_id, start_date,
        CASE WHEN dep_no % 10 = 9 THEN TIMESTAMP '2024-01-01 00:10:00' WHEN dep_no % 10 = 8 THEN TIMESTAMP '2023-12-31'
             ELSE NULL END AS end_date,
        CASE dep_no % 12 WHEN 5 THEN '61 * * * *' WHEN 7 THEN '@daily' WHEN 3 THEN '0 0 L * *' WHEN 2 THEN '30 6 * * 5#3'
             WHEN 1 THEN '@reboot' WHEN 9 THEN '0 0 * * * 30' ELSE cron END AS cron,
        CASE WHEN dep_no % 9 = 4 THEN '' ELSE dag_id END AS dag FROM {fx_deployments})
    SELECT id, 'missing_dag_id' AS issue FROM d WHERE dag = ''
    UNION ALL SELECT id, 'end_not_after_start' FROM d WHERE end_date <= start_date
    UNION ALL SELECT id, CASE cron WHEN '@reboot' THEN 'unsupported_cron' ELSE 'invalid_cron' END FROM d WHERE cron IN ('61 * * * *', '@reboot')""")
def _(h):
    from runlens.functions import cron

    deps = h.fx_deployments.selectExpr(
        "id", "start_date", "CASE WHEN dep_no % 9 = 4 THEN '' ELSE dag_id END AS dag_id",
        "CASE WHEN dep_no % 10 = 9 THEN TIMESTAMP_NTZ '2024-01-01 00:10:00' "
        "WHEN dep_no % 10 = 8 THEN TIMESTAMP_NTZ '2023-12-31' END AS end_date",
        "CASE dep_no % 12 WHEN 5 THEN '61 * * * *' WHEN 7 THEN '@daily' WHEN 3 THEN '0 0 L * *' WHEN 2 THEN '30 6 * * 5#3' "
        "WHEN 1 THEN '@reboot' WHEN 9 THEN '0 0 * * * 30' ELSE cron END AS cron",
    )
    return filters.validate_deployments(deps, cron.parse("cron")["status"])


@check("fp19_split_lines", """
    SELECT doc_id, CAST(pos - 1 AS BIGINT) AS line_no, line AS msg,
           CASE WHEN channel = 'stdout' THEN 'INFO' ELSE 'ERROR' END AS level
    FROM (SELECT doc_id, channel, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {fx_lines})
    WHERE line <> ''""")
def _(h):
    return filters.split_lines(h.fx_lines, "text").select("doc_id", big("line_no"), "msg", "level")


@check("fp20_tag_logs", """
    SELECT seq, source, dag_id, run_id, task_id, attempt,
           '{{"props":"' || replace(extra, '"', chr(92) || '"') || '","value":"' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '"}}' AS extra
    FROM {fx_logs}""")
def _(h):
    tags = F.when(F.col("source") == "task", F.struct("dag_id", "run_id", "task_id", "attempt"))
    attributes = F.create_map(
        F.lit("props"), F.col("extra"),
        F.lit("value"), F.expr("CAST(CAST(floor(value) AS BIGINT) AS STRING)"),
        F.lit("levelno"), F.lit("20"), F.lit("_private"), F.lit("x"), F.lit("name"), F.col("msg"),
    )
    raw = h.fx_logs.select("seq", tags.alias("tags"), attributes.alias("attributes"))
    return filters.tag_logs(raw).withColumn("extra", maps.sorted_json(F.col("extra")))


# --- trigger rules ----------------------------------------------------------

COUNTS = """
    SELECT s.dag_id, s.run_id, e.downstream AS task_id,
           count(*) FILTER (s.state = 'success') AS n_success,
           count(*) FILTER (s.state = 'failed') AS n_failed,
           count(*) FILTER (s.state = 'skipped') AS n_skipped,
           count(*) FILTER (s.state NOT IN ('success', 'failed', 'skipped')) AS n_upstream_failed,
           count(*) AS n_done,
           count(*) FILTER (s.state IN ('success','failed','skipped','upstream_failed','removed')) AS n_terminal,
           count(*) FILTER (s.state IN ('failed', 'upstream_failed')) AS n_broken
    FROM {fx_task_states} s JOIN {fx_edges} e ON e.dag_id = s.dag_id AND e.upstream = s.task_id
    GROUP BY ALL"""
COUNTED = """counts AS (""" + COUNTS + """),
    totals AS (SELECT dag_id, downstream AS task_id, count(*) AS n_total FROM {fx_edges} GROUP BY ALL),
    cells AS (SELECT r.dag_id, r.run_id, t.task_id, t.trigger_rule, coalesce(n_total, 0) AS total,
                coalesce(n_success, 0) AS ok, coalesce(n_failed, 0) AS ko, coalesce(n_skipped, 0) AS sk,
                coalesce(n_done, 0) AS done, coalesce(n_terminal, 0) AS fin, coalesce(n_broken, 0) AS broken,
                t.teardown
              FROM {fx_runs} r JOIN {fx_tasks} t ON t.dag_id = r.dag_id
              LEFT JOIN totals n ON n.dag_id = t.dag_id AND n.task_id = t.task_id
              LEFT JOIN counts c ON c.dag_id = r.dag_id AND c.run_id = r.run_id AND c.task_id = t.task_id)"""
OUTCOMES = {
    "all_success": "done >= total AND ok = total", "all_failed": "done >= total AND ko = total",
    "all_done": "done >= total", "all_skipped": "done >= total AND sk = total",
    "one_success": "ok >= 1", "one_failed": "ko >= 1",
    "none_failed": "done >= total AND ko = 0", "none_skipped": "done >= total AND sk = 0",
    "none_failed_min_one_success": "done >= total AND ko = 0 AND ok >= 1",
    "none_failed_or_skipped": "done >= total AND ko = 0 AND sk = 0",
}
OWN_RULE = "(total = 0 OR CASE trigger_rule " + " ".join(
    f"WHEN '{rule}' THEN {text}" for rule, text in OUTCOMES.items()
) + " END)"


@check("tr1_upstream_counts", COUNTS.replace(
    "count(*) AS n_done,", "count(*) AS n_done, count(*) AS n_total,"))
def _(h):
    return rules.upstream_counts(h.fx_edges, h.fx_task_states)


@check("tr2_trigger_rules", f"WITH {COUNTED} SELECT dag_id, run_id, task_id, trigger_rule, {OWN_RULE} AS satisfied FROM cells")
def _(h):
    return rules.evaluate_trigger_rules(
        catalog(h.fx_tasks), h.fx_edges, h.fx_task_states, h.fx_runs
    ).select("dag_id", "run_id", "task_id", "trigger_rule", "satisfied")


@check("tr3_all_rules_wide", f"WITH {COUNTED} SELECT dag_id, run_id, task_id, " + ", ".join(
    f"(total = 0 OR ({text})) AS {rule}" for rule, text in OUTCOMES.items()) + " FROM cells")
def _(h):
    return rules.evaluate_all_rules(
        catalog(h.fx_tasks), h.fx_edges, h.fx_task_states, h.fx_runs, wide=True
    )


@check("tr3_all_rules_long", f"WITH {COUNTED} " + " UNION ALL ".join(
    f"SELECT dag_id, run_id, task_id, '{rule}' AS rule, (total = 0 OR ({text})) AS satisfied FROM cells"
    for rule, text in OUTCOMES.items()))
def _(h):
    return rules.evaluate_all_rules(
        catalog(h.fx_tasks), h.fx_edges, h.fx_task_states, h.fx_runs
    )


@check("tr4_run_states", """
    SELECT r.dag_id, r.run_id, CASE
        WHEN count(s.task_id) = 0 THEN 'running'
        WHEN count(s.task_id) FILTER (s.state NOT IN ('success', 'failed', 'skipped', 'upstream_failed', 'removed')) > 0 THEN 'running'
        WHEN count(s.task_id) FILTER (s.task_id <> 't7' AND s.state IN ('failed', 'upstream_failed')) > 0 THEN 'failed'
        ELSE 'success' END AS run_state
    FROM {fx_runs} r LEFT JOIN {fx_task_states} s ON s.dag_id = r.dag_id AND s.run_id = r.run_id GROUP BY ALL""")
def _(h):
    return rules.run_states(h.fx_task_states, G.teardown_pairs(h.fx_tasks), h.fx_runs)


@check("tr5_ready_tasks", f"""
    WITH {COUNTED}
    SELECT c.dag_id, c.run_id, c.task_id, trigger_rule,
           CASE WHEN fin < total THEN 'wait' WHEN {OWN_RULE} THEN 'run'
                WHEN broken > 0 THEN 'upstream_failed' ELSE 'skipped' END AS decision
    FROM cells c WHERE teardown IS NULL AND NOT EXISTS
        (SELECT 1 FROM {{fx_task_states}} s WHERE s.dag_id = c.dag_id AND s.run_id = c.run_id
         AND s.task_id = c.task_id AND s.state <> 'none')""")
def _(h):
    return rules.ready_tasks(
        sets.normal_tasks(catalog(h.fx_tasks)), h.fx_edges, h.fx_task_states, h.fx_runs
    )


# --- aggregates ---------------------------------------------------------------


@check("ag1_state_map", """
    SELECT dag_id, run_id, '{{' || string_agg('"' || task_id || '":"' || state || '"', ',' ORDER BY task_id) || '}}' AS task_states
    FROM {fx_task_states} GROUP BY ALL""")
def _(h):
    return aggregates.state_map(h.fx_task_states).withColumn(
        "task_states", F.to_json("task_states")
    )


@check("ag2_context_map", """
    SELECT dag_id, run_id, string_agg(task_id || '=' || outputs, ';' ORDER BY task_id) AS contexts
    FROM {fx_task_states} GROUP BY ALL""")
def _(h):
    packed = aggregates.context_map(h.fx_task_states.select("dag_id", "run_id", "task_id", "outputs"))
    parts = F.transform("contexts", lambda c: F.concat(c["task_id"], F.lit("="), c["context"]["outputs"]))
    return packed.select("dag_id", "run_id", F.array_join(parts, ";").alias("contexts"))


@check("ag3_active_counts", """
    SELECT deployment_id, count(*) AS active_runs FROM {fx_runs} WHERE state = 'running' GROUP BY ALL""")
def _(h):
    return aggregates.active_counts(h.fx_runs)


@check("ag4_fleet_counts", """
    WITH m AS (SELECT 'runs' AS measure, dag_id, state FROM {fx_runs}
        UNION ALL SELECT 'actions', dag_id, type FROM {fx_tasks}
        UNION ALL SELECT 'deployments', dag_id, CASE WHEN enabled THEN 'enabled' ELSE 'disabled' END FROM {fx_deployments})
    SELECT measure, dag_id, state, count(*) AS n,
           CASE WHEN GROUPING(dag_id) = 0 THEN 0 WHEN GROUPING(state) = 0 THEN 2 ELSE 3 END AS level
    FROM m GROUP BY GROUPING SETS ((measure, dag_id, state), (measure, state), (measure))""")
def _(h):
    counts = aggregates.fleet_counts(h.fx_runs, h.fx_tasks, h.fx_deployments)
    return counts.withColumn("level", F.col("level").cast("int"))


@check("ag4_bundle_counts", """
    SELECT concat('b', CAST(dag_no % 50 AS VARCHAR)) AS bundle, count(*) AS dags,
           count(*) FILTER (dag_no % 7 = 3) AS failed
    FROM {fx_dags} GROUP BY 1""")
def _(h):
    dags = h.fx_dags.selectExpr(
        "concat('b', dag_no % 50) AS bundle", "dag_id", "dag_no % 7 <> 3 AS is_valid"
    )
    return aggregates.bundle_counts(dags)


@check("ag5_multi_dag_folders", """
    SELECT regexp_replace(url, '/[^/]*$', '') AS folder, count(DISTINCT url) AS files
    FROM {pages} GROUP BY 1 HAVING count(DISTINCT url) > 1""")
def _(h):
    documents = h.pages.select(
        F.regexp_replace("url", "/[^/]*$", "").alias("folder"), F.col("url").alias("file")
    )
    return aggregates.multi_dag_folders(documents)


@check("ag6_duplicate_task_ids", """
    SELECT dag_id, task_id, count(*) AS uses FROM {fx_plan_tasks} GROUP BY ALL HAVING count(*) > 1""")
def _(h):
    return aggregates.duplicate_task_ids(h.fx_plan_tasks)


@check("ag7_required_variables", """
    WITH calls AS (SELECT task_no, 'v' || regexp_extract(template, 'vars\\("v(\\d)"\\)', 1) AS var_key, CAST(NULL AS VARCHAR) AS d FROM {fx_inputs}
        UNION ALL SELECT task_no, 'v9', '"none"' FROM {fx_inputs} WHERE task_no % 2 = 0)
    SELECT var_key, bool_and(d IS NOT NULL) AS has_default,
           CASE WHEN bool_and(d IS NOT NULL) THEN arg_min(d, task_no) END AS default_value,
           CASE WHEN var_key IN (SELECT var_key FROM {fx_variable_layers}) THEN 'variables' END AS found_in
    FROM calls GROUP BY var_key""")
def _(h):
    provided = h.fx_variable_layers.groupBy("var_key").agg(F.min("var_value").alias("var_value"))
    return aggregates.required_variables(
        h.fx_inputs.select("task_no", "template"), provided, ["task_no"]
    )


@check("ag8_required_secrets", """
    SELECT DISTINCT 'KEY_' || CAST(p_size AS VARCHAR) AS key,
           CASE WHEN p_size IN (SELECT n_nationkey FROM {nation}) THEN 'environment' END AS found_in
    FROM {part} WHERE p_partkey % 3 = 0""")
def _(h):
    provided = h.nation.select(F.concat(F.lit("KEY_"), F.col("n_nationkey")).alias("key"))
    return aggregates.required_secrets(h.fx_inputs, provided)


# --- windows --------------------------------------------------------------------

ORDER = ["updated_at", "seq1", "seq2", "seq3"]


@check("wn1_current_states", "SELECT run_id, task_id, state, updated_at FROM {fx_task_states}")
def _(h):
    return windows.current_states(h.fx_task_events, ORDER).select(
        "run_id", "task_id", "state", "updated_at"
    )


@check("wn2_latest_attempts", """
    SELECT task_no, attempt_number, state, error FROM {fx_attempts}
    QUALIFY row_number() OVER (PARTITION BY task_no ORDER BY attempt_number DESC) = 1""")
def _(h):
    return windows.latest_attempts(h.fx_attempts, ["task_no"]).select(
        "task_no", "attempt_number", "state", "error"
    )


@check("wn3_number_attempts", """
    SELECT run_id, task_id, seq1, seq2, seq3, row_number() OVER (PARTITION BY dag_id, run_id, task_id
        ORDER BY updated_at, seq1, seq2, seq3) AS attempt_number
    FROM {fx_task_events}""")
def _(h):
    return windows.number_attempts(h.fx_task_events, windows.TASK_KEY, ORDER).select(
        "run_id", "task_id", "seq1", "seq2", "seq3", "attempt_number"
    )


@check("wn4_dedup_scheduled_runs", """
    WITH k AS (SELECT *, date_trunc('second', logical_date) AS s FROM {fx_candidates})
    SELECT dag_id, run_id, part_no, created_at,
           logical_date IS NULL OR row_number() OVER w = 1 AS created,
           CASE WHEN logical_date IS NULL THEN run_id ELSE first_value(run_id) OVER w END AS actual_run_id
    FROM k WINDOW w AS (PARTITION BY dag_id, s ORDER BY created_at, instance_no, line_no, part_no)""")
def _(h):
    return windows.dedup_scheduled_runs(
        h.fx_candidates, ["created_at", "instance_no", "line_no", "part_no"]
    ).select("dag_id", "run_id", "part_no", "created_at", "created", "actual_run_id")


@check("wn5_claim_triggers", """
    SELECT trigger_id, instance_id AS claimed_by, claimed_at FROM {fx_claims}
    QUALIFY row_number() OVER (PARTITION BY trigger_id ORDER BY claimed_at, seq) = 1""")
def _(h):
    return windows.claim_triggers(h.fx_claims, ["claimed_at", "seq"])


@check("wn5_drained_by_instance", """
    SELECT claimed_by, count(*) AS drained FROM (SELECT instance_id AS claimed_by FROM {fx_claims}
    QUALIFY row_number() OVER (PARTITION BY trigger_id ORDER BY claimed_at, seq) = 1) GROUP BY ALL""")
def _(h):
    return windows.drained_by_instance(h.fx_claims, ["claimed_at", "seq"])


@check("wn6_claim_ticks", """
    WITH m AS (SELECT *, max(proposed_at) OVER (PARTITION BY deployment_id ORDER BY arrival_seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {fx_tick_updates})
    SELECT deployment_id, arrival_seq, before IS NULL OR proposed_at > before AS accepted FROM m""")
def _(h):
    return windows.claim_ticks(h.fx_tick_updates).select("deployment_id", "arrival_seq", "accepted")


@check("wn8_audit_transitions", """
    WITH p AS (SELECT run_id, task_id, seq1, seq2, seq3, state AS to_state,
        lag(state) OVER (PARTITION BY dag_id, run_id, task_id ORDER BY updated_at, seq1, seq2, seq3) AS from_state
        FROM {fx_task_events})
    SELECT *, (from_state || '>' || to_state) IN ('none>scheduled','none>skipped','none>upstream_failed','scheduled>queued',
        'queued>running','running>success','running>failed','running>skipped','running>up_for_retry',
        'up_for_retry>queued','up_for_retry>failed','none>queued') AS is_legal
    FROM p WHERE from_state IS NOT NULL""")
def _(h):
    return windows.audit_transitions(h.fx_task_events, ORDER, legal=OBSERVED_TRANSITIONS).select(
        "run_id", "task_id", "seq1", "seq2", "seq3", "from_state", "to_state", "is_legal"
    )


# --- ordering and sets ------------------------------------------------------------


@check("tk1_recent_runs", """
    SELECT run_id, dag_id, state FROM {fx_runs} ORDER BY created_at DESC, run_id DESC LIMIT 50""")
def _(h):
    return ordering.recent_runs(h.fx_runs).select("run_id", "dag_id", "state")


@check("tk2_recent_runs_per_dag", """
    SELECT dag_id, run_id, row_number() OVER (PARTITION BY dag_id ORDER BY created_at DESC, run_id DESC) AS rank
    FROM {fx_runs} QUALIFY rank <= 5""")
def _(h):
    return ordering.recent_runs_per_dag(h.fx_runs, 5).select("dag_id", "run_id", big("rank"))


@check("tk3_list_deployments", "SELECT id, dag_id, cron, enabled FROM {fx_deployments} ORDER BY id")
def _(h):
    return ordering.list_deployments(h.fx_deployments).select("id", "dag_id", "cron", "enabled")


@check("tk4_drain_order", """
    SELECT trigger_id, deployment_id, created_at FROM {fx_triggers} ORDER BY created_at, trigger_id""")
def _(h):
    return ordering.drain_order(h.fx_triggers).select("trigger_id", "deployment_id", "created_at")


@check("st1_normal_tasks", "SELECT dag_id, task_id, type FROM {fx_tasks} WHERE teardown IS NULL")
def _(h):
    return sets.normal_tasks(h.fx_tasks).select("dag_id", "task_id", "type")


@check("st2_affected_teardowns", """
    WITH touched AS (SELECT DISTINCT dag_id, run_id, task_id FROM {fx_task_states} WHERE state = 'failed')
    SELECT DISTINCT dag_id, run_id, 't7' AS task_id FROM touched t WHERE task_id IN ('t3', 't4', 't5', 't6')
        AND NOT EXISTS (SELECT 1 FROM touched x WHERE x.run_id = t.run_id AND x.dag_id = t.dag_id AND x.task_id = 't7')""")
def _(h):
    touched = h.fx_task_states.filter("state = 'failed'").select("dag_id", "run_id", "task_id")
    deps = G.teardown_deps(h.fx_edges, G.teardown_pairs(h.fx_tasks))
    return sets.affected_teardowns(deps, touched)


@check("st3_branch_split", """
    WITH c AS (SELECT run_id, CASE run_no % 4 WHEN 0 THEN ['t4'] WHEN 1 THEN ['t5', 't9'] WHEN 2 THEN ['t4', 't5'] ELSE [] END AS chosen FROM {fx_runs})
    SELECT run_id, array_to_string(list_filter(chosen, lambda x: x IN ('t4', 't5')), ',') AS scheduled,
           array_to_string(list_filter(['t4', 't5'], lambda x: NOT list_contains(chosen, x)), ',') AS skipped FROM c""")
def _(h):
    chosen = listed("chosen")
    down = F.array(F.lit("t4"), F.lit("t5"))
    picked = h.fx_runs.selectExpr(
        "run_id", "CASE run_no % 4 WHEN 0 THEN 't4' WHEN 1 THEN 't5,t9' WHEN 2 THEN 't4,t5' ELSE '' END AS chosen"
    )
    scheduled, skipped = sets.branch_split(chosen, F.array(F.lit("t4")), F.array(F.lit("t5")), down)
    return picked.select(
        "run_id", F.array_join(scheduled, ",").alias("scheduled"),
        F.array_join(skipped, ",").alias("skipped"),
    )


@check("st4_union_sources", """
    SELECT 'manual' AS source, deployment_id, trigger_id, CAST(NULL AS VARCHAR) AS run_id, created_at AS logical_date FROM {fx_triggers}
    UNION ALL SELECT 'recovered', deployment_id, NULL, run_id, logical_date FROM {fx_runs} WHERE state = 'running'
    UNION ALL SELECT 'scheduled', id, NULL, NULL, start_date FROM {fx_deployments} WHERE enabled AND cron IS NOT NULL""")
def _(h):
    return sets.union_sources([
        h.fx_triggers.selectExpr("'manual' AS source", "deployment_id", "trigger_id", "created_at AS logical_date"),
        filters.active_runs(h.fx_runs).selectExpr("'recovered' AS source", "deployment_id", "run_id", "logical_date"),
        h.fx_deployments.filter("enabled AND cron IS NOT NULL").selectExpr(
            "'scheduled' AS source", "id AS deployment_id", "start_date AS logical_date"
        ),
    ])

