"""Importing this module registers every query."""

from pyspark.sql import DataFrame

from runlens.operators import graph, rules, sets, windows
from runlens.plans import checks_fleet, checks_joins, checks_schedule, checks_sources, checks_states  # noqa: F401
from runlens.plans.checks import catalog
from runlens.plans.views import History
from runlens.session import cut_lineage


def runnable_tasks(h: History) -> DataFrame:
    """Compacts the event log, evaluates every task's rule and the state of each run."""
    order = ["updated_at", "seq1", "seq2", "seq3"]
    # Three readers: the log is compacted once.
    states = cut_lineage(windows.current_states(h.fx_task_events, order).select(
        "dag_id", "run_id", "task_id", "state"
    ))
    tasks = catalog(h.fx_tasks)
    ready = rules.ready_tasks(
        sets.normal_tasks(tasks), graph.adjacency(tasks), states, h.fx_runs
    )
    verdicts = rules.run_states(states, graph.teardown_pairs(tasks), h.fx_runs)
    return ready.join(verdicts, ["dag_id", "run_id"], "left")
