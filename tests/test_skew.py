"""Hot keys: the spread forms give what the plain forms give."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions import blocks
from runlens.functions.skew import spread_join
from runlens.operators import rules, windows
from runlens.plans.views import History


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(11)
    data = [
        ("hot" if rng.random() < 0.5 else rng.choice("abcdefgh"), rng.randrange(500), n, f"v{n}")
        for n in range(3000)
    ]
    data += [("hot", 1, 5000, "same")] * 300
    return spark.createDataFrame(data, "k string, rank long, seq long, v string").cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("zz", 4)], "k string, x int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_is_a_plain_join(hot, small, how):
    assert rows(spread_join(hot, small, ["k"], how)) == rows(hot.join(small, "k", how))


def test_spread_join_parts_a_hot_key(hot, small, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        joined = spread_join(hot, small, ["k"]).filter("k = 'hot'")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert len(sizes) >= 6 and max(sizes) < sum(sizes) / 2


def test_first_of_key(hot):
    w = Window.partitionBy("k").orderBy("rank", "seq").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    plain = hot.withColumn("first_v", F.first("v").over(w))
    assert rows(blocks.with_first(hot, ["k"], ["rank", "seq"], {"first_v": "v"})) == rows(plain)


def test_compaction_of_a_hot_key(hot):
    w = Window.partitionBy("k").orderBy(F.desc("rank"), F.desc("seq"))
    plain = hot.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    assert rows(windows.current_states(hot, ["rank", "seq"], ["k"]), "k", "rank", "seq", "v") == rows(plain)


def test_one_winner_among_very_many_creators(spark):
    df = spark.range(2000).selectExpr(
        "'g' AS dag_id", "TIMESTAMP_NTZ '2026-01-01' AS logical_date", "concat('r', id) AS run_id",
        "pmod(id * 7919, 2000) AS seq",
    )
    got = windows.dedup_scheduled_runs(df, ["seq"])
    assert got.filter("created").count() == 1
    assert rows(got.select("actual_run_id").distinct()) == rows(df.filter("seq = 0").select("run_id"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_the_catalog_are_not_broadcast(spark, tmp_path):
    """A small file may hold a large catalog: neither it nor its copies go through the driver."""
    catalog = spark.range(2000).selectExpr("concat('d', id) AS dag_id", "'t1' AS upstream", "'t2' AS downstream")
    catalog.write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    states = spark.range(10).selectExpr("concat('d', id) AS dag_id", "'r' AS run_id", "'t1' AS task_id", "'success' AS state")
    plan = _plan(rules.upstream_counts(edges, states))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_first_holds_each_column_once(hot):
    """Columns to take that the order has already are not shuffled a second time."""
    found = blocks.with_first(hot, ["k"], ["rank", "seq", "v"], {"first_v": "v", "first_rank": "rank"})
    plan = _plan(found)
    assert "__take" not in plan
    assert "REPARTITION_BY_COL" in plan  # the rows of a block meet before its first is taken


def test_only_blocks_with_a_carry_are_joined(hot):
    for known in (blocks.numbered(hot, ["k"], ["seq"], "n"), blocks.neighbour(hot, ["k"], ["seq", "rank"], {"before": "v"})):
        assert "isnotnull(__carry" in _plan(known)


def test_runs_are_not_broadcast_to_their_tasks_events(spark, tmp_path):
    """A file of runs that Spark takes for small holds many times its size in rows."""
    spark.range(50).selectExpr(
        "id AS o_orderkey", "id % 5 AS o_custkey", "'F' AS o_orderstatus", "TIMESTAMP_NTZ '2024-01-01' AS o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(100).selectExpr(
        "id % 50 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "id AS l_linenumber", "1.0D AS l_quantity",
        "2.0D AS l_extendedprice", "'A' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP_NTZ '2024-01-02' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    history = History(spark, str(tmp_path))
    for view in (history.fx_task_events, history.fx_task_states, history.fx_candidates):
        assert "Broadcast" not in _plan(view) and view.count() == 100
