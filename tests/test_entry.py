"""The entry points: names, and the flagship query on the smallest tables."""

import __spark_entry__ as entry
from conftest import rows

from runlens.plans.views import History


def test_every_query_has_its_sql():
    """The training-data queries aside, of which some have none."""
    assert set(entry.queries()) - set(entry.LLM_QUERIES) == set(entry.oracle_sql()) - set(entry.LLM_SQL)


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["dag_id", "run_id", "task_id", "trigger_rule", "decision", "run_state"]
    assert {r[0] for r in got.select("decision").distinct().collect()} == {"run", "wait", "skipped", "upstream_failed"}


def test_views_are_pruned_to_the_columns_asked_for(spark, folder):
    runs = History(spark, folder).fx_runs.filter("run_no = 7").select("run_no", "logical_date")
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plan
    assert len(rows(runs)) == 1
