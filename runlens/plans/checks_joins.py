"""Queries over joins, graphs, routing and recovery."""

from pyspark.sql import functions as F


from runlens.operators import graph as G
from runlens.operators import joins, recovery, routing

from runlens.plans import catalog as plan
from runlens.plans import reconcile
from runlens.plans.checks import big, catalog, check, moment


NO_CONTEXT = "CASE WHEN outputs LIKE '{{%' AND outputs <> '{{}}' THEN outputs END"


def registry(h):
    """Plugins that are registered: one per brand, and `py`."""
    names = F.explode(F.array(F.col("p_brand"), F.lit("py"))).alias("plugin_name")
    return h.part.select(names).distinct()


@check("jn1_upstream_outputs", f"""
    WITH links AS (SELECT dag_id, upstream, downstream FROM {{fx_edges}}
                   UNION SELECT dag_id, teardown, task_id FROM {{fx_tasks}} WHERE teardown IS NOT NULL),
    o AS (SELECT dag_id, run_id, task_id, {NO_CONTEXT} AS o FROM {{fx_task_states}}),
    g AS (SELECT o.dag_id, o.run_id, l.downstream AS task_id,
                 string_agg(l.upstream || '=' || o.o, ';' ORDER BY l.upstream) AS upstream_outputs
          FROM o JOIN links l ON l.dag_id = o.dag_id AND l.upstream = o.task_id WHERE o.o IS NOT NULL GROUP BY ALL)
    SELECT s.dag_id, s.run_id, s.task_id, coalesce(g.upstream_outputs, '') AS upstream_outputs
    FROM {{fx_task_states}} s LEFT JOIN g USING (dag_id, run_id, task_id)""")
def _(h):
    found = joins.resolve_upstream_outputs(h.fx_edges, h.fx_task_states, G.teardown_pairs(h.fx_tasks))
    entries = F.transform(
        F.map_entries("upstream_outputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return found.withColumn("upstream_outputs", F.array_join(F.array_sort(entries), ";"))


LOST = """SELECT t.dag_id, t.task_id, 'error' AS severity, 'missing_upstream' AS code, u.up AS concerns
    FROM {fx_plan_tasks} t, unnest(split(t.upstream_list, ',')) AS u(up)
    WHERE u.up <> '' AND NOT EXISTS (SELECT 1 FROM {fx_plan_tasks} k WHERE k.dag_id = t.dag_id AND k.task_id = u.up)"""
PLUGINS = """SELECT dag_id, task_id, CASE WHEN uses LIKE '%@%' THEN 'warning' ELSE 'error' END AS severity,
        CASE WHEN uses LIKE '%@%' THEN 'remote_plugin' ELSE 'unknown_plugin' END AS code, uses AS concerns
    FROM {fx_plan_tasks} WHERE uses <> 'py'"""
TEARDOWNS = """SELECT dag_id, task_id, 'error' AS severity, 'missing_setup' AS code, teardown AS concerns
    FROM {fx_plan_tasks} t WHERE teardown IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM {fx_plan_tasks} k WHERE k.dag_id = t.dag_id AND k.task_id = t.teardown)
    UNION ALL SELECT dag_id, task_id, 'error', 'own_teardown', teardown
    FROM {fx_plan_tasks} WHERE teardown = task_id"""


@check("jn2_missing_upstreams", LOST)
def _(h):
    return joins.missing_upstreams(catalog(h.fx_plan_tasks))


@check("jn3_missing_plugins", PLUGINS)
def _(h):
    return joins.missing_plugins(h.fx_plan_tasks, registry(h))


@check("jn4_bad_teardowns", TEARDOWNS)
def _(h):
    return joins.bad_teardowns(h.fx_plan_tasks)


@check("jn5_roll_deployments", """
    SELECT d.id, CASE WHEN c.version IS NULL THEN 'unknown'
        WHEN pinned AND dag_version IS NOT NULL AND dag_version <> version THEN 'pinned_stale'
        WHEN pinned AND dag_version IS NOT NULL THEN 'pinned_current'
        WHEN dag_version = version THEN 'unchanged' ELSE 'rolled' END AS verdict,
        CASE WHEN c.version IS NULL THEN dag_version WHEN pinned AND dag_version IS NOT NULL THEN dag_version
             ELSE version END AS new_version
    FROM {fx_deployments} d LEFT JOIN {fx_catalog} c ON c.dag_id = d.dag_id""")
def _(h):
    return joins.roll_deployments(h.fx_deployments, h.fx_catalog).select("id", "verdict", "new_version")


@check("jn6_deployment_flags", """
    SELECT d.id, concat_ws(', ', CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN pinned THEN 'pinned' END,
        CASE WHEN dag_version <> version THEN 'stale (bundle: ' || version || ')' END) AS flags
    FROM {fx_deployments} d LEFT JOIN {fx_catalog} c ON c.dag_id = d.dag_id""")
def _(h):
    return joins.deployment_flags(h.fx_deployments, h.fx_catalog).select(
        "id", F.array_join("flags", ", ").alias("flags")
    )


@check("jn7_accept_versions", """
    SELECT d.id, dag_version AS previous_version, version AS new_version, 'accepted' AS outcome
    FROM {fx_deployments} d JOIN {fx_catalog} c ON c.dag_id = d.dag_id
    WHERE pinned AND dag_version IS DISTINCT FROM version""")
def _(h):
    return joins.accept_versions(h.fx_deployments, h.fx_catalog)


@check("jn7_accept_named_versions", """
    WITH n AS (SELECT DISTINCT deployment_id AS id FROM {fx_triggers})
    SELECT d.id, dag_version AS previous_version, version AS new_version, 'accepted' AS outcome
    FROM {fx_deployments} d JOIN {fx_catalog} c ON c.dag_id = d.dag_id WHERE d.id IN (SELECT id FROM n)
    UNION ALL SELECT id, NULL, NULL, 'not_found' FROM n WHERE id NOT IN (SELECT id FROM {fx_deployments})""")
def _(h):
    ids = h.fx_triggers.select(F.col("deployment_id").alias("id"))
    return joins.accept_versions(h.fx_deployments, h.fx_catalog, ids)


MISSING = """SELECT t.trigger_id, t.deployment_id, r.var_key,
        'missing_variable' AS error
    FROM {fx_triggers} t JOIN {fx_requirements} r ON r.deployment_id = t.deployment_id
    WHERE NOT r.has_default AND NOT r.overridden AND t.variables NOT LIKE '%"' || r.var_key || '"%'"""


@check("jn8_validate_triggers", MISSING)
def _(h):
    return joins.validate_triggers(h.fx_triggers, h.fx_requirements)


@check("jn9_admit_triggers", f"""
    WITH bad AS (SELECT DISTINCT trigger_id FROM ({MISSING})),
    act AS (SELECT deployment_id, count(*) AS n FROM {{fx_runs}} WHERE state = 'running' GROUP BY ALL),
    facts AS (SELECT t.*, d.id, d.dag_id, d.max_active_runs, coalesce(a.n, 0) AS n,
                     t.trigger_id IN (SELECT trigger_id FROM bad) AS wrong,
                     coalesce(d.dag_id IN (SELECT dag_id FROM {{fx_dags}}), false) AS loaded
              FROM {{fx_triggers}} t LEFT JOIN {{fx_deployments}} d ON d.id = t.deployment_id
              LEFT JOIN act a ON a.deployment_id = t.deployment_id),
    queued AS (SELECT *, coalesce(sum(CASE WHEN NOT wrong AND loaded THEN 1 ELSE 0 END) OVER (PARTITION BY deployment_id
                   ORDER BY created_at, trigger_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM facts)
    SELECT trigger_id, dag_id, CASE WHEN id IS NULL THEN 'unknown_deployment'
        WHEN n + taken >= max_active_runs THEN 'max_active_runs'
        WHEN wrong THEN 'invalid_variables' WHEN NOT loaded THEN 'unknown_dag' ELSE 'admitted' END AS verdict
    FROM queued""")
def _(h):
    from runlens.operators.aggregates import active_counts

    return joins.admit_triggers(
        h.fx_triggers, h.fx_deployments, h.fx_dags, active_counts(h.fx_runs), h.fx_requirements
    ).select("trigger_id", "dag_id", "verdict")


@check("jn10_runs_for_date", """
    WITH r AS (SELECT dag_id, run_id, created_at, logical_date + to_minutes(CAST(run_no % 4 * 15 AS INTEGER)) AS ld FROM {fx_runs}),
    q AS (SELECT run_no AS request_id, dag_id, logical_date + to_minutes(CAST(run_no % 3 * 15 AS INTEGER)) AS wanted FROM {fx_runs}),
    m AS (SELECT request_id, arg_max(run_id, created_at) AS run_id FROM q JOIN r ON r.dag_id = q.dag_id
              AND CAST(r.ld AS DATE) = CAST(q.wanted AS DATE)
          WHERE q.wanted = date_trunc('day', q.wanted) OR r.ld = q.wanted GROUP BY ALL)
    SELECT q.request_id, m.run_id FROM q LEFT JOIN m USING (request_id)""")
def _(h):
    runs = h.fx_runs.withColumn(
        "logical_date", F.timestamp_add("MINUTE", (F.col("run_no") % 4 * 15).cast("int"), F.col("logical_date"))
    )
    requests = h.fx_runs.select(
        F.col("run_no").alias("request_id"), "dag_id",
        F.timestamp_add("MINUTE", (F.col("run_no") % 3 * 15).cast("int"), F.col("logical_date")).alias("wanted"),
    )
    return joins.runs_for_date(requests, runs).select("request_id", "run_id")


@check("jn13_attempt_logs", """
    WITH l AS (SELECT seq, dag_id, run_id, task_id, coalesce(attempt, 1) AS attempt FROM {fx_logs} WHERE source = 'task'),
    q AS (SELECT DISTINCT dag_id, run_id, task_id, CASE WHEN value > 60 THEN 2 END AS want FROM {fx_logs}
          WHERE source = 'task' AND level = 'ERROR'),
    x AS (SELECT dag_id, run_id, task_id, max(attempt) AS last FROM l GROUP BY ALL),
    c AS (SELECT DISTINCT q.dag_id, q.run_id, q.task_id, coalesce(q.want, x.last) AS attempt FROM q JOIN x USING (dag_id, run_id, task_id))
    SELECT l.seq, CAST(l.attempt AS BIGINT) AS attempt FROM l JOIN c USING (dag_id, run_id, task_id, attempt)""")
def _(h):
    requests = h.fx_logs.filter("source = 'task' AND level = 'ERROR'").selectExpr(
        "dag_id", "run_id", "task_id", "CASE WHEN value > 60 THEN 2 END AS attempt"
    )
    return joins.attempt_logs(h.fx_logs, requests).select("seq", big("attempt"))


@check("jn14_resume_view", f"""
    SELECT r.dag_id, r.run_id, t.task_id, coalesce(s.state, 'none') AS state,
           CASE WHEN s.state IN ('success','failed','skipped','upstream_failed','removed') THEN {NO_CONTEXT} END AS outputs
    FROM {{fx_runs}} r JOIN {{fx_tasks}} t ON t.dag_id = r.dag_id
    LEFT JOIN {{fx_task_states}} s ON s.dag_id = r.dag_id AND s.run_id = r.run_id AND s.task_id = t.task_id""")
def _(h):
    return joins.resume_view(h.fx_tasks, h.fx_runs, h.fx_task_states, h.fx_task_states)


@check("jn16_run_report", """
    SELECT s.dag_id, s.run_id, s.task_id, r.state = 'success' AS run_passed, s.state,
           CASE WHEN s.outputs LIKE '{{%' THEN s.outputs ELSE '{{}}' END AS outputs, s.state = 'success' AS task_passed
    FROM {fx_task_states} s JOIN {fx_runs} r ON r.run_no = s.run_no""")
def _(h):
    return joins.run_report(h.fx_runs, h.fx_task_states, h.fx_task_states)


# In the faulty catalog t8 and t9 of a `loop` DAG wait for each other only if
# t8 exists; t9 always waits for itself.
CYCLES = """SELECT DISTINCT dag_id, task_id, 'error' AS severity, 'cyclic' AS code, CAST(NULL AS VARCHAR) AS concerns
    FROM {fx_plan_tasks} WHERE task_id = 't9'"""
REPEATS = """SELECT dag_id, task_id, 'error' AS severity, 'repeated_task' AS code, CAST(NULL AS VARCHAR) AS concerns
    FROM {fx_plan_tasks} GROUP BY dag_id, task_id HAVING count(*) > 1"""
ISSUES = f"{REPEATS} UNION ALL {LOST} UNION ALL {PLUGINS} UNION ALL {TEARDOWNS} UNION ALL {CYCLES}"


@check("jn17_catalog_issues", ISSUES)
def _(h):
    return plan.catalog_issues(catalog(h.fx_plan_tasks), registry(h))


@check("jn17_plan_catalog", f"""
    WITH i AS (SELECT dag_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w
               FROM ({ISSUES}) GROUP BY ALL)
    SELECT dag_id, count(*) AS tasks, coalesce(max(e), 0) = 0 AS is_valid, coalesce(max(e), 0) AS errors, coalesce(max(w), 0) AS warnings
    FROM {{fx_plan_tasks}} LEFT JOIN i USING (dag_id) GROUP BY dag_id""")
def _(h):
    return plan.plan_catalog(catalog(h.fx_plan_tasks), registry(h))


# Inputs of 40 DAGs; v5 and every second secret are not provided, every eleventh input names something unknown.
_INPUTS = """SELECT concat('dag-', CAST(task_no % 40 AS STRING)) AS dag_id, concat('t', CAST(task_no % 7 + 1 AS STRING)) AS task_id,
    concat(template, CASE WHEN task_no % 11 = 0 THEN ' {{{{ ds }}}}' ELSE '' END) AS template FROM {fx_inputs}"""


@check("jn17_input_issues", """
    WITH i AS (SELECT 'dag-' || (task_no % 40) AS dag_id, 't' || (task_no % 7 + 1) AS task_id, task_no, p_size
               FROM {fx_inputs} JOIN {part} ON p_partkey = task_no)
    SELECT DISTINCT dag_id, CAST(NULL AS VARCHAR) AS task_id, 'warning' AS severity, 'missing_variable' AS code, 'v5' AS concerns FROM i WHERE p_size % 6 = 5
    UNION ALL SELECT DISTINCT dag_id, NULL, 'warning', 'missing_secret', 'KEY_' || p_size FROM i WHERE task_no % 3 = 0 AND p_size % 2 = 1
    UNION ALL SELECT DISTINCT dag_id, task_id, 'warning', 'unknown_reference', 'ds' FROM i WHERE task_no % 11 = 0""")
def _(h):
    inputs = h.sql(_INPUTS)
    provided = inputs.select("dag_id").distinct().withColumn("var_key", F.explode(F.array(*[F.lit(f"v{i}") for i in range(5)])))
    secrets = h.part.filter("p_size % 2 = 0").select(F.concat(F.lit("KEY_"), F.col("p_size").cast("string")).alias("key"))
    return plan.input_issues(inputs, provided.withColumn("var_value", F.lit('"x"')), secrets)


# --- graph -----------------------------------------------------------------------


@check("gr2_adjacency", """
    SELECT t.dag_id, u.up AS upstream, t.task_id AS downstream
    FROM {fx_plan_tasks} t, unnest(split(t.upstream_list, ',')) AS u(up)
    WHERE EXISTS (SELECT 1 FROM {fx_plan_tasks} k WHERE k.dag_id = t.dag_id AND k.task_id = u.up)""")
def _(h):
    return G.adjacency(catalog(h.fx_plan_tasks))


@check("gr3_descendants", """
    WITH RECURSIVE walk AS (
        SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM {part}
        UNION SELECT w.root, e.downstream, w.depth + 1 FROM walk w JOIN {fx_big_edges} e ON e.upstream = w.node)
    SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY root, node""")
def _(h):
    seeds = h.part.select(F.col("p_partkey").alias("root"))
    return G.descendants(h.fx_big_edges, seeds, graph=()).select("root", "node", big("depth"))


@check("gr3_dag_descendants", """
    WITH RECURSIVE walk AS (
        SELECT dag_id, task_id AS root, task_id AS node, 0 AS depth FROM {fx_tasks}
        UNION SELECT w.dag_id, w.root, e.downstream, w.depth + 1 FROM walk w
              JOIN {fx_edges} e ON e.dag_id = w.dag_id AND e.upstream = w.node)
    SELECT dag_id, root, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL""")
def _(h):
    seeds = h.fx_tasks.select("dag_id", F.col("task_id").alias("root"))
    return G.descendants(h.fx_edges, seeds).select("dag_id", "root", "node", big("depth"))


@check("gr4_find_cycles", """
    WITH RECURSIVE reach AS (
        SELECT upstream AS root, downstream AS node FROM {fx_cyclic_edges}
        UNION SELECT r.root, e.downstream FROM reach r JOIN {fx_cyclic_edges} e ON e.upstream = r.node),
    ring AS (SELECT root FROM reach WHERE root = node)
    SELECT DISTINCT node FROM reach WHERE root IN (SELECT root FROM ring)""")
def _(h):
    return G.find_cycles(h.fx_cyclic_edges, graph=())


@check("gr5_topo_levels", """
    WITH RECURSIVE up AS (
        SELECT p_partkey AS node, 0 AS level FROM {part} WHERE p_partkey IN (SELECT upstream FROM {fx_big_edges})
            AND p_partkey NOT IN (SELECT downstream FROM {fx_big_edges})
        UNION SELECT e.downstream, u.level + 1 FROM up u JOIN {fx_big_edges} e ON e.upstream = u.node),
    best AS (SELECT node, CAST(max(level) AS BIGINT) AS level FROM up GROUP BY node)
    SELECT node, level, row_number() OVER (ORDER BY level, node) AS topo_order FROM best""")
def _(h):
    return G.topo_levels(h.fx_big_edges, graph=()).select("node", big("level"), "topo_order")


@check("gr5_execution_order", """
    SELECT dag_id, task_id, row_number() OVER (PARTITION BY dag_id ORDER BY task_id) AS position FROM {fx_tasks}""")
def _(h):
    return G.execution_order(h.fx_tasks, h.fx_edges)


@check("gr6_teardown_deps", """
    WITH RECURSIVE walk AS (
        SELECT dag_id, task_id AS teardown, teardown AS dep FROM {fx_tasks} WHERE teardown IS NOT NULL
        UNION SELECT w.dag_id, w.teardown, e.downstream FROM walk w
              JOIN {fx_edges} e ON e.dag_id = w.dag_id AND e.upstream = w.dep)
    SELECT dag_id, teardown, dep FROM walk""")
def _(h):
    return G.teardown_deps(h.fx_edges, G.teardown_pairs(h.fx_tasks))


CLEARED = """
    requests AS (SELECT dag_id, run_id, CASE WHEN run_no % 50 = 7 AND task_id = 't1' THEN 't99' ELSE task_id END AS task_id,
                 run_no % 2 = 0 AS downstream FROM {fx_task_states} WHERE state = 'failed'),
    lost AS (SELECT DISTINCT dag_id, run_id, task_id FROM requests WHERE task_id = 't99'),
    fine AS (SELECT * FROM requests WHERE run_id NOT IN (SELECT run_id FROM lost)),
    walk AS (SELECT dag_id, run_id, task_id, downstream FROM fine
             UNION SELECT w.dag_id, w.run_id, e.downstream, TRUE FROM walk w
                   JOIN {fx_edges} e ON e.dag_id = w.dag_id AND e.upstream = w.task_id WHERE w.downstream),
    asked AS (SELECT DISTINCT dag_id, run_id, task_id FROM fine),
    below AS (SELECT DISTINCT dag_id, run_id, task_id FROM walk EXCEPT SELECT * FROM asked),
    touched AS (SELECT * FROM asked UNION ALL SELECT * FROM below),
    again AS (SELECT DISTINCT dag_id, run_id, 't7' AS task_id FROM touched WHERE task_id IN ('t3', 't4', 't5', 't6')
              EXCEPT SELECT * FROM touched)"""


def _clear_requests(h):
    return h.fx_task_states.filter("state = 'failed'").selectExpr(
        "dag_id", "run_id",
        "CASE WHEN run_no % 50 = 7 AND task_id = 't1' THEN 't99' ELSE task_id END AS task_id",
        "run_no % 2 = 0 AS downstream",
    )


def _cleared(h):
    return G.clear_set(
        h.fx_tasks, h.fx_edges, G.teardown_pairs(h.fx_tasks), _clear_requests(h)
    )


@check("gr7_clear_set", f"""
    WITH RECURSIVE {CLEARED}
    SELECT *, 'requested' AS reason FROM asked UNION ALL SELECT *, 'downstream' FROM below
    UNION ALL SELECT *, 'teardown' FROM again UNION ALL SELECT *, 'unknown_task' FROM lost""")
def _(h):
    return _cleared(h)


@check("gr8_mark_effects", """
    WITH marks AS (SELECT dag_id, run_id, task_id, CASE run_no % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'success' ELSE 'skipped' END AS state
                   FROM {fx_task_states} WHERE state = 'running' AND run_no % 4 <> 3)
    SELECT *, 'marked' AS effect FROM marks
    UNION ALL SELECT DISTINCT dag_id, run_id, 't7', 'none', 'teardown_cleared' FROM marks m
    WHERE task_id IN ('t3', 't4', 't5', 't6')
      AND NOT EXISTS (SELECT 1 FROM marks x WHERE x.run_id = m.run_id AND x.task_id = 't7')""")
def _(h):
    requests = h.fx_task_states.filter("state = 'running'").selectExpr(
        "dag_id", "run_id", "task_id",
        "CASE run_no % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'success' WHEN 2 THEN 'skipped' ELSE 'queued' END AS state",
    )
    return G.mark_effects(h.fx_edges, G.teardown_pairs(h.fx_tasks), requests)


# --- routing ---------------------------------------------------------------------


def _results(h):
    return h.fx_results.withColumns({
        "success": F.array(F.lit("t4")), "failure": F.array(F.lit("t5")),
    })


@check("rt1_normalize_outputs", """
    SELECT run_id, CASE WHEN run_no % 10 IN (0, 1, 2, 3, 7, 8) THEN '{{}}' ELSE raw_outputs END AS outputs FROM {fx_results}""")
def _(h):
    return routing.normalize_outputs(h.fx_results).select("run_id", "outputs")


BRANCH = """CASE run_no % 10 WHEN 1 THEN ['t5'] WHEN 3 THEN ['t5'] WHEN 4 THEN ['t4', 't5'] ELSE ['t4'] END"""


@check("rt2_branch_outputs", f"""
    SELECT run_id, array_to_string({BRANCH}, ',') AS branch FROM {{fx_results}}""")
def _(h):
    return routing.branch_outputs(_results(h)).select("run_id", F.array_join("branch", ",").alias("branch"))


BRANCHED = f"""SELECT dag_id, run_id, task_id, CASE WHEN list_contains(b, t.target) THEN 'schedule' ELSE 'skip' END AS directive, t.target
    FROM (SELECT *, {BRANCH} AS b FROM {{fx_results}} WHERE task_type = 'branch'), unnest(['t4', 't5']) AS t(target)"""
GATED = """SELECT dag_id, run_id, task_id, CASE WHEN run_no % 10 IN (1, 5, 8) THEN 'skip' ELSE 'schedule' END AS directive, t.target
    FROM {fx_results}, unnest(['t4', 't5']) AS t(target) WHERE task_type = 'short_circuit'"""


@check("rt3_branch_directives", BRANCHED)
def _(h):
    return routing.branch_directives(_results(h).filter("task_type = 'branch'"), h.fx_edges)


@check("rt4_short_circuit_directives", GATED)
def _(h):
    return routing.short_circuit_directives(
        h.fx_results.filter("task_type = 'short_circuit'"), h.fx_edges
    )


def _rule(number: int, deps: list[str]) -> str:
    """SQL for the state of task `number` of the seven-task catalog."""
    def count(states: str) -> str:
        return "(" + " + ".join(f"CAST({d} IN ({states}) AS INT)" for d in deps) + ")"

    n, ok, ko, sk = len(deps), count("'success'"), count("'failed'"), count("'skipped'")
    rules = [
        f"{ok} = {n}", f"{ko} = {n}", "TRUE", f"{sk} = {n}", f"{ok} >= 1", f"{ko} >= 1",
        f"{ko} = 0", f"{sk} = 0", f"({ko} = 0 AND {ok} >= 1)", f"({ko} = 0 AND {sk} = 0)",
    ]
    chosen = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(rules))
    done = count("'success','failed','skipped','upstream_failed'")
    broken = count("'failed','upstream_failed'")
    return (
        f"CASE WHEN {done} < {n} THEN 'none' WHEN CASE (dag_no + {number}) % 10 {chosen} END THEN o{number} "
        f"WHEN {broken} > 0 THEN 'upstream_failed' ELSE 'skipped' END"
    )


def _skip(target: str) -> str:
    return (
        "s3 = 'success' AND run_id IN (SELECT run_id FROM orders_out "
        f"WHERE directive = 'skip' AND target = '{target}')"
    )


def _reconcile_sql() -> str:
    cells = ", ".join(
        f"coalesce(max(CASE WHEN s.task_id = 't{i}' AND s.state <> 'upstream_failed' THEN s.state END), 'none') AS o{i}, "
        f"coalesce(max(CASE WHEN s.task_id = 't{i}' THEN s.state END), 'none') AS r{i}" for i in range(1, 8)
    )
    rows = " UNION ALL ".join(
        f"SELECT dag_id, run_id, 't{i}' AS task_id, r{i} AS recorded_state, s{i} AS implied_state, r{i} = s{i} AS agrees FROM l4"
        for i in range(1, 8)
    )
    ended = "(s3 IN {0} AND s4 IN {0} AND s5 IN {0} AND s6 IN {0})".format(
        "('success','failed','skipped','upstream_failed')")
    return f"""
    WITH orders_out AS ({BRANCHED} UNION ALL {GATED}),
    cells AS (SELECT r.dag_no, r.dag_id, r.run_id, {cells}
              FROM {{fx_runs}} r LEFT JOIN {{fx_task_states}} s ON s.run_no = r.run_no GROUP BY r.dag_no, r.dag_id, r.run_id),
    l1 AS (SELECT *, o1 AS s1 FROM cells),
    l2 AS (SELECT *, {_rule(2, ["s1"])} AS s2, {_rule(3, ["s1"])} AS s3 FROM l1),
    l3 AS (SELECT *, CASE WHEN {_skip("t4")} THEN 'skipped' ELSE {_rule(4, ["s2", "s3"])} END AS s4,
                     CASE WHEN {_skip("t5")} THEN 'skipped' ELSE {_rule(5, ["s3"])} END AS s5 FROM l2),
    l3b AS (SELECT *, {_rule(6, ["s4"])} AS s6 FROM l3),
    l4 AS (SELECT *, CASE WHEN {ended} THEN o7 ELSE 'none' END AS s7 FROM l3b)
    {rows}"""


@check("gr9_reconcile_states", _reconcile_sql())
def _(h):
    results = _results(h)
    directives = routing.branch_directives(
        results.filter("task_type = 'branch'"), h.fx_edges
    ).unionByName(
        routing.short_circuit_directives(results.filter("task_type = 'short_circuit'"), h.fx_edges)
    )
    return reconcile.reconcile_states(catalog(h.fx_tasks), h.fx_runs, h.fx_task_states, directives)


# --- recovery --------------------------------------------------------------------

ZOMBIE_NOW = "2001-06-01 00:00:00"
ZOMBIES = f"""SELECT s.dag_id, s.run_id, s.task_id, s.state, s.heartbeat_at,
        coalesce((epoch_us(TIMESTAMP '{ZOMBIE_NOW}') - epoch_us(s.heartbeat_at)) / 1e6, 301.0) AS seconds_since_heartbeat
    FROM {{fx_task_states}} s JOIN {{fx_runs}} r ON r.run_no = s.run_no
    WHERE s.state = 'running' AND r.state = 'running'
      AND (s.heartbeat_at IS NULL OR s.heartbeat_at < TIMESTAMP '{ZOMBIE_NOW}' - INTERVAL 300 SECOND)"""


def _zombies(h):
    return recovery.zombie_tasks(h.fx_runs, h.fx_task_states, moment(ZOMBIE_NOW))


@check("rc1_zombie_tasks", ZOMBIES)
def _(h):
    return _zombies(h)


@check("rc2_kill_zombies", f"""
    WITH z AS ({ZOMBIES})
    SELECT run_id, task_id, CASE WHEN (run_id, task_id) IN (SELECT (run_id, task_id) FROM z) AND updated_at < TIMESTAMP '{ZOMBIE_NOW}'
                                 THEN 'failed' ELSE state END AS state
    FROM {{fx_task_states}}""")
def _(h):
    from runlens.operators.windows import current_states

    order = ["updated_at", "seq1", "seq2", "seq3"]
    killed = recovery.kill_zombies(h.fx_task_events, _zombies(h), moment(ZOMBIE_NOW))
    return current_states(killed, order).select("run_id", "task_id", "state")


@check("rc3_finalize_orphans", """
    SELECT r.dag_id, r.run_id, CASE WHEN coalesce(bool_and(s.state = 'success'), TRUE) THEN 'success' ELSE 'failed' END AS final_state
    FROM {fx_runs} r LEFT JOIN {fx_task_states} s ON s.run_no = r.run_no WHERE r.state = 'running'
    GROUP BY ALL HAVING coalesce(bool_and(s.state IN ('success','failed','skipped','upstream_failed','removed')), TRUE)""")
def _(h):
    return recovery.finalize_orphans(h.fx_runs, h.fx_task_states)


@check("rc4_recoverable_runs", """
    SELECT r.dag_id, r.run_id, string_agg(s.task_id, ',' ORDER BY s.task_id) AS open_tasks, r.dag_id IN (SELECT dag_id FROM {fx_runs} WHERE state = 'failed') AS is_known
    FROM {fx_runs} r JOIN {fx_task_states} s ON s.run_no = r.run_no
    WHERE r.state = 'running' AND s.state NOT IN ('success','failed','skipped','upstream_failed','removed') GROUP BY ALL""")
def _(h):
    loaded = h.fx_runs.filter("state = 'failed'").select("dag_id")
    return recovery.recoverable_runs(h.fx_runs, h.fx_task_states, loaded).select(
        "dag_id", "run_id", F.array_join("non_terminal_tasks", ",").alias("open_tasks"), "is_known"
    )


@check("rc5_clear_tasks", f"""
    WITH RECURSIVE {CLEARED}, hit AS (SELECT * FROM touched UNION ALL SELECT * FROM again)
    SELECT coalesce(s.dag_id, c.dag_id) AS dag_id, coalesce(s.run_id, c.run_id) AS run_id, coalesce(s.task_id, c.task_id) AS task_id,
           CASE WHEN c.run_id IS NOT NULL THEN 'none' ELSE s.state END AS state, s.heartbeat_at
    FROM {{fx_task_states}} s FULL JOIN hit c ON c.dag_id = s.dag_id AND c.run_id = s.run_id AND c.task_id = s.task_id""")
def _(h):
    cleared = _cleared(h).filter("reason <> 'unknown_task'")
    return recovery.clear_states(h.fx_task_states, cleared).select(
        "dag_id", "run_id", "task_id", "state", "heartbeat_at"
    )


@check("rc5_clear_contexts", """
    SELECT dag_id, run_id, task_id, CASE WHEN state = 'failed' OR state = 'success' THEN '{{}}' ELSE outputs END AS outputs
    FROM {fx_task_states}""")
def _(h):
    ended = h.fx_task_states.filter("state IN ('failed', 'success')")
    return recovery.clear_contexts(h.fx_task_states, ended).select("dag_id", "run_id", "task_id", "outputs")


@check("rc6_upsert_deployments", """
    WITH n AS (SELECT deployment_id AS id, 'v9' AS dag_version FROM {fx_triggers} GROUP BY ALL)
    SELECT coalesce(n.id, d.id) AS id, coalesce(n.dag_version, d.dag_version) AS dag_version, d.last_scheduled_at
    FROM {fx_deployments} d FULL JOIN n ON n.id = d.id""")
def _(h):
    current = h.fx_deployments.select("id", "dag_id", "dag_version", "last_scheduled_at")
    incoming = h.fx_triggers.groupBy(F.col("deployment_id").alias("id")).agg(
        F.lit("dag-new").alias("dag_id"), F.lit("v9").alias("dag_version"),
        F.lit(None).cast("timestamp_ntz").alias("last_scheduled_at"),
    )
    return recovery.upsert_deployments(current, incoming).select("id", "dag_version", "last_scheduled_at")


@check("rc7_delete_by_key", """
    SELECT id FROM {fx_deployments} WHERE id NOT IN (SELECT deployment_id FROM {fx_triggers})
    UNION ALL SELECT CAST(count(*) AS VARCHAR) FROM {fx_deployments} WHERE id IN (SELECT deployment_id FROM {fx_triggers})""")
def _(h):
    keys = h.fx_triggers.select(F.col("deployment_id").alias("id")).distinct()
    kept, gone = recovery.delete_by_key(h.fx_deployments, keys)
    return kept.select("id").unionByName(gone.select(F.col("deleted").cast("string").alias("id")))


@check("rc8_set_enabled", """
    WITH q AS (SELECT deployment_id AS id, max(run_no) % 2 = 0 AS flag FROM {fx_runs} WHERE state = 'failed' GROUP BY ALL)
    SELECT d.id, coalesce(q.flag, d.enabled) AS enabled FROM {fx_deployments} d LEFT JOIN q ON q.id = d.id""")
def _(h):
    requests = h.fx_runs.filter("state = 'failed'").groupBy(F.col("deployment_id").alias("id")).agg(
        (F.max("run_no") % 2 == 0).alias("flag")
    )
    return recovery.set_enabled(h.fx_deployments, requests).select("id", "enabled")


@check("rc9_close_runs", f"""
    WITH v AS (SELECT run_no, CASE WHEN bool_or(state IN ('failed', 'upstream_failed')) THEN 'failed'
                 WHEN bool_and(state IN ('success','failed','skipped','upstream_failed','removed')) THEN 'success'
                 ELSE 'running' END AS run_state FROM {{fx_task_states}} GROUP BY ALL)
    SELECT r.run_id, coalesce(v.run_state, r.state) AS state,
           CASE WHEN v.run_state IS NULL THEN r.ended_at WHEN v.run_state = 'running' THEN NULL
                ELSE TIMESTAMP '{ZOMBIE_NOW}' END AS ended_at
    FROM {{fx_runs}} r LEFT JOIN v USING (run_no)""")
def _(h):
    from runlens.functions.states import is_terminal

    verdicts = h.fx_task_states.groupBy("dag_id", "run_id").agg(
        F.when(F.bool_or(F.col("state").isin("failed", "upstream_failed")), "failed")
        .when(F.bool_and(is_terminal(F.col("state"))), "success")
        .otherwise("running").alias("run_state")
    )
    return recovery.close_runs(h.fx_runs, verdicts, moment(ZOMBIE_NOW)).select("run_id", "state", "ended_at")


