"""Truth tables of the trigger rules and of task and run states."""

import itertools

import pytest
from conftest import rows

from runlens.operators import filters, rules
from runlens.values import LEGAL_TRANSITIONS, TASK_STATES, TERMINAL_STATES, TRIGGER_RULES


def expected(rule, states, total=None):
    """The rules once more, written as set conditions over a list of states."""
    total = len(states) if total is None else total
    if total == 0:
        return True
    ok, ko, sk = (states.count(s) for s in ("success", "failed", "skipped"))
    complete = len(states) >= total
    return {
        "all_success": complete and ok == total,
        "all_failed": complete and ko == total,
        "all_done": complete,
        "all_skipped": complete and sk == total,
        "one_success": ok > 0,
        "one_failed": ko > 0,
        "none_failed": complete and not ko,
        "none_skipped": complete and not sk,
        "none_failed_min_one_success": complete and not ko and ok > 0,
        "none_failed_or_skipped": complete and not ko and not sk,
    }[rule]


@pytest.fixture(scope="module")
def truth(spark):
    """One run per combination of up to three upstream states, two of them partial."""
    outcomes = ["success", "failed", "skipped", "upstream_failed", "removed"]
    combos = [c for n in range(4) for c in itertools.product(outcomes, repeat=n)]
    cases, states, runs = {}, [], []
    for number, combo in enumerate(combos):
        run = f"r{number}"
        cases[run] = list(combo)
        runs.append(("d", run))
        states += [("d", run, f"u{i}", s) for i, s in enumerate(combo)]
    tasks = [("d", f"u{i}", "all_success", []) for i in range(3)] + [
        ("d", "down", "all_success", ["u0", "u1", "u2"]), ("d", "free", "all_failed", []),
    ]
    edges = [("d", f"u{i}", "down") for i in range(3)]
    return (
        cases,
        spark.createDataFrame(tasks, "dag_id string, task_id string, trigger_rule string, upstream array<string>"),
        spark.createDataFrame(edges, "dag_id string, upstream string, downstream string"),
        spark.createDataFrame(states, "dag_id string, run_id string, task_id string, state string"),
        spark.createDataFrame(runs, "dag_id string, run_id string"),
    )


def test_all_rules_on_all_combinations(truth):
    cases, tasks, edges, states, runs = truth
    wide = rules.evaluate_all_rules(tasks, edges, states, runs, wide=True).filter("task_id = 'down'")
    got = {row["run_id"]: row for row in wide.collect()}
    assert len(got) == len(cases)
    for run, seen in cases.items():
        for rule in TRIGGER_RULES:
            assert got[run][rule] == expected(rule, seen, 3), (rule, seen)


def test_no_upstream_satisfies_every_rule(truth):
    _, tasks, edges, states, runs = truth
    long = rules.evaluate_all_rules(tasks, edges, states, runs).filter("task_id = 'free'")
    assert {row["satisfied"] for row in long.collect()} == {True}


def test_ready_tasks_follow_the_runner(truth):
    cases, tasks, edges, states, runs = truth
    got = {
        row["run_id"]: row["decision"]
        for row in rules.ready_tasks(tasks, edges, states, runs).filter("task_id = 'down'").collect()
    }
    for run, seen in cases.items():
        if len(seen) < 3:
            want = "wait"
        elif expected("all_success", seen, 3):
            want = "run"
        else:
            want = "upstream_failed" if {"failed", "upstream_failed"} & set(seen) else "skipped"
        assert got[run] == want, seen


def test_open_upstream_keeps_a_task_waiting(spark):
    tasks = spark.createDataFrame(
        [("d", "a", "all_success", []), ("d", "b", "one_success", ["a", "c"]), ("d", "c", "all_success", [])],
        "dag_id string, task_id string, trigger_rule string, upstream array<string>",
    )
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "c", "b")], "dag_id string, upstream string, downstream string")
    states = spark.createDataFrame(
        [("d", "r", "a", "success"), ("d", "r", "c", "running")],
        "dag_id string, run_id string, task_id string, state string",
    )
    runs = spark.createDataFrame([("d", "r")], "dag_id string, run_id string")
    # The rule itself already holds, the runner still waits for the open task.
    held = rules.evaluate_trigger_rules(tasks, edges, states, runs).filter("task_id = 'b'")
    assert held.first()["satisfied"] is True
    assert rows(rules.ready_tasks(tasks, edges, states, runs), "task_id", "decision") == [("b", "wait")]


def test_run_state_ignores_teardowns(spark):
    states = spark.createDataFrame(
        [("d", "r1", "a", "success"), ("d", "r1", "td", "failed"),
         ("d", "r2", "a", "skipped"), ("d", "r3", "a", "upstream_failed"), ("d", "r4", "td", "failed")],
        "dag_id string, run_id string, task_id string, state string",
    )
    teardowns = spark.createDataFrame([("d", "td", "a")], "dag_id string, teardown string, setup string")
    assert rows(rules.run_states(states, teardowns), "run_id", "run_state") == [
        ("r1", "success"), ("r2", "success"), ("r3", "failed"), ("r4", "success"),
    ]


def test_a_run_is_running_until_all_is_final(spark):
    states = spark.createDataFrame(
        [("d", "r1", "a", "failed"), ("d", "r1", "b", "running"), ("d", "r2", "a", "running")],
        "dag_id string, run_id string, task_id string, state string",
    )
    teardowns = spark.createDataFrame([], "dag_id string, teardown string, setup string")
    runs = spark.createDataFrame([("d", "r1"), ("d", "r2"), ("d", "r3")], "dag_id string, run_id string")
    assert rows(rules.run_states(states, teardowns, runs), "run_id", "run_state") == [
        ("r1", "running"), ("r2", "running"), ("r3", "running"),
    ]


def test_an_unknown_rule_is_named(spark):
    tasks = spark.createDataFrame(
        [("d", "a", "all_sucess", [])], "dag_id string, task_id string, trigger_rule string, upstream array<string>"
    )
    edges = spark.createDataFrame([], "dag_id string, upstream string, downstream string")
    states = spark.createDataFrame([], "dag_id string, run_id string, task_id string, state string")
    runs = spark.createDataFrame([("d", "r")], "dag_id string, run_id string")
    assert rows(rules.ready_tasks(tasks, edges, states, runs), "task_id", "decision") == [("a", "unknown_rule")]


def test_terminal_states(spark):
    df = spark.createDataFrame([(s,) for s in (*TASK_STATES, None)], "state string")
    got = {row["state"]: row["is_terminal"] for row in filters.with_terminal(df).collect()}
    assert {s for s, final in got.items() if final} == set(TERMINAL_STATES)
    assert got[None] is False


def test_transitions_name_known_states():
    assert {s for pair in LEGAL_TRANSITIONS for s in pair} <= set(TASK_STATES)


def test_outcomes_of_attempts(spark):
    cases = [
        (0, None, "success", False), (1, None, "failed", True), (2, None, "failed", False),
        (3, None, "skipped", False), (4, None, "failed", True), (77, None, "failed", True),
        (None, None, "success", False), (None, "TaskSkipped", "skipped", False),
        (None, "TaskFailed", "failed", False), (None, "TaskRetry", "failed", True),
        (None, "TimeoutError", "timed_out", True), (None, "KeyError", "failed", True),
        (None, "NotImplementedError", "failed", False),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "exit_code int, exception string")
    got = [tuple(r) for r in filters.classify_outcome(df).collect()]
    assert got == cases


def test_final_state_and_delay(spark):
    def attempts(*states):
        return [(i + 1, s) for i, s in enumerate(states)]

    df = spark.createDataFrame(
        [("a", attempts("failed", "failed", "success"), 3, 10, True),
         ("b", attempts("failed", "failed"), 3, 10, True),
         ("c", attempts("failed", "failed"), 3, 10, False),
         ("d", attempts("failed", "failed"), 1, 10, True),
         ("e", attempts("skipped"), 0, 10, True), ("f", attempts("timed_out"), 0, 10, True)],
        "k string, attempts array<struct<attempt_number:int,state:string>>, retries int, retry_delay int, exponential_backoff boolean",
    )
    assert rows(filters.final_state(df), "k", "final_state", "retry_delay_sec") == [
        ("a", "success", None), ("b", "up_for_retry", 20.0), ("c", "up_for_retry", 10.0),
        ("d", "failed", None), ("e", "skipped", None), ("f", "failed", None),
    ]
