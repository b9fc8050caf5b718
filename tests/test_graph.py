"""Graphs, routing and reconciliation on the shapes the run tests use."""

import random

from conftest import rows

from runlens.operators import graph as G
from runlens.operators import routing
from runlens.plans import catalog, reconcile

TASK = ("dag_id string, task_id string, upstream array<string>, trigger_rule string, teardown string, "
        "type string, uses string, success array<string>, failure array<string>")


def tasks_of(spark, dag, *specs):
    """Each spec is (task, upstream[, options])."""
    data = []
    for task, upstream, *rest in specs:
        o = rest[0] if rest else {}
        data.append((dag, task, upstream, o.get("rule", "all_success"), o.get("teardown"), o.get("type", "task"),
                     o.get("uses", "py"), o.get("success", []), o.get("failure", [])))
    return spark.createDataFrame(data, TASK)


def reconciled(spark, tasks, outcomes, raw=None, resume=False):
    """Implied states of one run of DAG `d` with the given recorded states."""
    runs = spark.createDataFrame([("d", "r")], "dag_id string, run_id string")
    recorded = spark.createDataFrame(
        [("d", "r", t, s) for t, s in outcomes.items()], "dag_id string, run_id string, task_id string, state string"
    )
    results = spark.createDataFrame(
        [("d", "r", t, text) for t, text in (raw or {}).items()],
        "dag_id string, run_id string, task_id string, raw_outputs string",
    ).join(tasks.select("dag_id", "task_id", "type", "success", "failure"), ["dag_id", "task_id"])
    edges = G.adjacency(tasks)
    directives = routing.branch_directives(results.filter("type = 'branch'"), edges).unionByName(
        routing.short_circuit_directives(results.filter("type = 'short_circuit'"), edges)
    )
    got = reconcile.reconcile_states(tasks, runs, recorded, directives, resume)
    return {row["task_id"]: row["implied_state"] for row in got.collect()}


def test_failure_spreads_downstream(spark):
    tasks = tasks_of(spark, "d", ("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["c"], {"rule": "all_done"}))
    got = reconciled(spark, tasks, {"a": "success", "b": "failed", "d": "success"})
    assert got == {"a": "success", "b": "failed", "c": "upstream_failed", "d": "success"}


def test_branch_skips_the_path_not_taken(spark):
    tasks = tasks_of(
        spark, "d", ("decide", [], {"type": "branch", "success": ["take_a"], "failure": ["take_b"]}),
        ("take_a", ["decide"]), ("take_b", ["decide"]), ("after_b", ["take_b"]),
    )
    ran = {"decide": "success", "take_a": "success"}
    assert reconciled(spark, tasks, ran, {"decide": '{"_result":["take_a"]}'}) == {
        "decide": "success", "take_a": "success", "take_b": "skipped", "after_b": "skipped",
    }
    # A branch that failed routes nothing.
    got = reconciled(spark, tasks, {"decide": "failed"}, {"decide": '{"_result":["take_a"]}'})
    assert got == {"decide": "failed", "take_a": "upstream_failed", "take_b": "upstream_failed", "after_b": "upstream_failed"}
    # On resume directives of ended tasks are not applied again.
    got = reconciled(spark, tasks, ran, {"decide": '{"_result":["take_a"]}'}, resume=True)
    assert got["take_b"] == "none"


def test_gate_skips_only_direct_downstream(spark):
    tasks = tasks_of(
        spark, "d", ("gate", [], {"type": "short_circuit"}), ("middle", ["gate"]),
        ("leaf", ["middle"]), ("always", ["middle"], {"rule": "all_done"}),
    )
    got = reconciled(spark, tasks, {"gate": "success", "always": "success"}, {"gate": '{"_result":false}'})
    assert got == {"gate": "success", "middle": "skipped", "leaf": "skipped", "always": "success"}


def test_teardown_runs_after_failure_and_waits_for_all(spark):
    tasks = tasks_of(
        spark, "d", ("create", []), ("etl", ["create"]), ("destroy", [], {"teardown": "create"}),
    )
    got = reconciled(spark, tasks, {"create": "success", "etl": "failed", "destroy": "success"})
    assert got == {"create": "success", "etl": "failed", "destroy": "success"}
    got = reconciled(spark, tasks, {"create": "success", "etl": "running", "destroy": "success"})
    assert got == {"create": "success", "etl": "running", "destroy": "none"}


def test_missing_upstream_never_gets_ready(spark):
    tasks = tasks_of(spark, "d", ("a", []), ("b", ["a", "ghost"]))
    assert reconciled(spark, tasks, {"a": "success", "b": "success"}) == {"a": "success", "b": "none"}


BRANCHES = [
    ('{"_result":["x","y"]}', ["x", "y"]), ('{"_result":"x"}', ["x"]), ('{"_result":true}', ["s"]),
    ('{"_result":false}', ["f"]), ('{"_result":7}', ["s"]), ('{"_result":null}', ["s"]),
    ('{"branch":["x"],"n":1}', ["x"]), ('{"branch":"x"}', None), ("{}", ["s"]), ('{"_result":"false"}', ["false"]),
]


def test_branch_outputs(spark):
    df = spark.createDataFrame(
        [(raw, ["s"], ["f"]) for raw, _ in BRANCHES],
        "raw_outputs string, success array<string>, failure array<string>",
    )
    got = [r["branch"] for r in routing.branch_outputs(df).collect()]
    assert got == [chosen for _, chosen in BRANCHES]


GATES = [
    ('{"_result":true}', True), ('{"_result":false}', False), ('{"_result":0}', False), ('{"_result":2}', True),
    ('{"_result":""}', False), ('{"_result":"false"}', True), ('{"_result":[]}', False), ('{"_result":{}}', False),
    ('{"_result":null}', False), ('{"continue":false}', False), ('{"continue":true}', True), ("{}", True), ('{"x":1}', True),
]


def test_gate(spark):
    df = spark.createDataFrame([(raw,) for raw, _ in GATES], "raw_outputs string")
    got = [r["continues"] for r in routing.gate_continues(df).collect()]
    assert got == [goes_on for _, goes_on in GATES]


def test_plain_outputs(spark):
    df = spark.createDataFrame([('{"_result":3}',), ('{"_result":3,"x":1}',), ('{"x":1}',), ("{}",)], "raw_outputs string")
    assert [r["outputs"] for r in routing.normalize_outputs(df).collect()] == ["{}", '{"_result":3,"x":1}', '{"x":1}', "{}"]


def random_edges(spark, seed, back):
    rng = random.Random(seed)
    pairs = set()
    for dag in ("p", "q"):
        for node in range(1, 30):
            for _ in range(rng.randrange(3)):
                pairs.add((dag, f"n{rng.randrange(node):02d}", f"n{node:02d}"))
    for _ in range(back):
        low, high = sorted(rng.sample(range(30), 2))
        pairs.add(("q", f"n{high:02d}", f"n{low:02d}"))
    return sorted(pairs), spark.createDataFrame(sorted(pairs), "dag_id string, upstream string, downstream string")


def test_descendants_and_levels_against_brute_force(spark):
    pairs, edges = random_edges(spark, 3, 0)
    down, nodes = {}, set()
    for dag, up, low in pairs:
        down.setdefault((dag, up), set()).add(low)
        nodes |= {(dag, up), (dag, low)}
    want, level = [], {}
    for dag, node in sorted(nodes):
        depth, frontier, seen = 0, {node}, {node: 0}
        while frontier:
            depth += 1
            frontier = {c for n in frontier for c in down.get((dag, n), ())} - set(seen)
            seen |= {c: depth for c in frontier}
        want += [(dag, node, n, d) for n, d in seen.items()]
        level.setdefault((dag, node), 0)
    for dag, node in sorted(nodes):  # names are in topological order
        for child in down.get((dag, node), ()):
            level[(dag, child)] = max(level[(dag, child)], level[(dag, node)] + 1)
    seeds = spark.createDataFrame(sorted(nodes), "dag_id string, root string")
    assert rows(G.descendants(edges, seeds), "dag_id", "root", "node", "depth") == sorted(want, key=repr)
    got = G.topo_levels(edges)
    assert rows(got, "dag_id", "node", "level") == sorted(((*k, v) for k, v in level.items()), key=repr)
    assert G.find_cycles(edges).count() == 0


def test_cycles_against_brute_force(spark):
    pairs, edges = random_edges(spark, 4, 3)
    open_up = {}
    for dag, up, low in pairs:
        open_up.setdefault((dag, up), set())
        open_up.setdefault((dag, low), set()).add(up)
    while free := [k for k, ups in open_up.items() if not ups]:
        for dag, node in free:
            del open_up[(dag, node)]
        for (dag, _), ups in open_up.items():
            ups -= {n for d, n in free if d == dag}
    assert rows(G.find_cycles(edges)) == sorted(open_up, key=repr)


def test_execution_order_breaks_ties_by_name(spark):
    tasks = tasks_of(spark, "d", ("a", []), ("b", []), ("aa", ["a"]), ("z", ["b", "aa"]))
    got = G.execution_order(tasks, G.adjacency(tasks))
    assert [r["task_id"] for r in got.orderBy("position").collect()] == ["a", "aa", "b", "z"]


def test_clear_and_mark_fire_teardowns_again(spark):
    tasks = tasks_of(
        spark, "d", ("setup", []), ("work", ["setup"]), ("report", ["work"]),
        ("td", [], {"teardown": "setup"}), ("other", []),
    )
    edges, teardowns = G.adjacency(tasks), G.teardown_pairs(tasks)

    def clear(*requests):
        df = spark.createDataFrame(list(requests), "dag_id string, run_id string, task_id string, downstream boolean")
        return rows(G.clear_set(tasks, edges, teardowns, df), "run_id", "task_id", "reason")

    assert clear(("d", "r", "work", False)) == [("r", "td", "teardown"), ("r", "work", "requested")]
    assert clear(("d", "r", "setup", True)) == [
        ("r", "report", "downstream"), ("r", "setup", "requested"), ("r", "td", "teardown"), ("r", "work", "downstream"),
    ]
    assert clear(("d", "r", "other", True)) == [("r", "other", "requested")]
    assert clear(("d", "r", "work", False), ("d", "r", "nope", False), ("d", "s", "other", False)) == [
        ("r", "nope", "unknown_task"), ("s", "other", "requested"),
    ]
    marks = spark.createDataFrame(
        [("d", "r", "work", "failed"), ("d", "s", "td", "success"), ("d", "s", "setup", "skipped"), ("d", "t", "work", "queued")],
        "dag_id string, run_id string, task_id string, state string",
    )
    assert rows(G.mark_effects(edges, teardowns, marks), "run_id", "task_id", "effect") == [
        ("r", "td", "teardown_cleared"), ("r", "work", "marked"), ("s", "setup", "marked"), ("s", "td", "marked"),
    ]


def test_two_teardowns_of_one_setup_are_both_kept(spark):
    tasks = tasks_of(spark, "d", ("s", []), ("x", ["s"]), ("t1", [], {"teardown": "s"}), ("t2", [], {"teardown": "s"}))
    assert rows(G.teardown_deps(G.adjacency(tasks), G.teardown_pairs(tasks)), "teardown", "dep") == [
        ("t1", "s"), ("t1", "x"), ("t2", "s"), ("t2", "x"),
    ]


def test_plan_checks(spark):
    tasks = tasks_of(
        spark, "bad", ("a", ["ghost"]), ("a", []), ("b", [], {"teardown": "b"}), ("c", ["d"]), ("d", ["c"]),
        ("e", [], {"uses": "nope"}), ("f", [], {"uses": "org/repo@1.0", "teardown": "gone"}),
    ).unionByName(tasks_of(spark, "good", ("a", []), ("b", ["a"])))
    registry = spark.createDataFrame([("py",)], "plugin_name string")
    issues = catalog.catalog_issues(tasks, registry)
    assert rows(issues, "dag_id", "task_id", "severity", "code", "concerns") == sorted([
        ("bad", "a", "error", "repeated_task", None), ("bad", "a", "error", "missing_upstream", "ghost"),
        ("bad", "b", "error", "own_teardown", "b"), ("bad", "c", "error", "cyclic", None), ("bad", "d", "error", "cyclic", None),
        ("bad", "e", "error", "unknown_plugin", "nope"), ("bad", "f", "error", "missing_setup", "gone"),
        ("bad", "f", "warning", "remote_plugin", "org/repo@1.0"),
    ], key=repr)
    assert rows(catalog.plan_catalog(tasks, registry), "dag_id", "is_valid") == [("bad", False), ("good", True)]


def test_nested_groups_flatten_to_leaves(spark):
    text = '[{"id":"a"},{"id":"g","actions":[{"id":"b"},{"id":"h","actions":[{"id":"c"}]},{"id":"empty","actions":[]}]}]'
    df = spark.createDataFrame([("d", text)], "dag_id string, actions string")
    assert rows(G.flatten_group_rows(df), "task_id", "group_path") == [("a", ""), ("b", "g"), ("c", "g/h"), ("empty", "g")]


def test_joins_of_the_graph_are_not_broadcast(spark, tmp_path):
    tasks = spark.range(2000).selectExpr("concat('d', id) AS dag_id", "'t2' AS task_id", "array('t1') AS upstream")
    tasks.write.parquet(f"{tmp_path}/tasks")
    tasks = spark.read.parquet(f"{tmp_path}/tasks")
    assert "Broadcast" not in G.adjacency(tasks)._jdf.queryExecution().executedPlan().toString()
