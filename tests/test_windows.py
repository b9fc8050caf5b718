"""Winners and block-wise windows, also with one key that holds most rows."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions import blocks
from runlens.operators import windows


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows belong to one key, over many days."""
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    data = [
        ("hot" if rng.random() < 0.66 else f"k{rng.randrange(40)}",
         start + dt.timedelta(minutes=rng.randrange(60 * 24 * 30)), seq, rng.randrange(1000))
        for seq in range(4000)
    ]
    return spark.createDataFrame(data, "k string, at timestamp_ntz, seq long, v long").cache()


@pytest.mark.parametrize("order", [["at", "seq"], ["seq"]])
def test_blocks_equal_plain_windows(skewed, order, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 300)
    w = Window.partitionBy("k").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.select(
        "k", "seq", F.row_number().over(w).cast("long").alias("n"), F.lag("v").over(w).alias("p"),
        F.lead("v").over(w).alias("f"), F.max("v").over(before).alias("m"),
    )
    n = blocks.numbered(skewed, ["k"], order, "n").select("k", "seq", "n")
    p = blocks.neighbour(skewed, ["k"], order, {"p": "v"}).select("k", "seq", "p")
    f = blocks.neighbour(skewed, ["k"], order, {"f": "v"}, following=True).select("k", "seq", "f")
    m = blocks.running_max_before(skewed, ["k"], order, "v", "m").select("k", "seq", "m")
    got = n.join(p, ["k", "seq"]).join(f, ["k", "seq"]).join(m, ["k", "seq"])
    assert rows(got, "k", "seq", "n", "p", "f", "m") == rows(plain)


def test_hot_key_is_cut_into_blocks(skewed):
    assert blocks.with_block(skewed, "at").filter("k = 'hot'").select("__block").distinct().count() == 30


def test_tick_updates_accept_only_later(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    df = spark.createDataFrame(
        [("d", t(3), 1), ("d", t(3), 2), ("d", t(5), 3), ("d", t(4), 4), ("e", t(1), 1)],
        "deployment_id string, proposed_at timestamp_ntz, arrival_seq long",
    )
    got = windows.claim_ticks(df)
    assert rows(got, "deployment_id", "arrival_seq", "accepted") == [
        ("d", 1, True), ("d", 2, False), ("d", 3, True), ("d", 4, False), ("e", 1, True),
    ]


def test_one_creator_wins_and_manual_runs_never_lose(spark):
    at = dt.datetime(2026, 6, 6, 12)
    df = spark.createDataFrame(
        [("g", at, "scheduled-g-20260606T120000", 2), ("g", at.replace(microsecond=7), "other", 1),
         ("g", at, "third", 3), ("g", None, "manual-g-1", 1), ("g", None, "manual-g-2", 1)],
        "dag_id string, logical_date timestamp_ntz, run_id string, seq int",
    )
    got = windows.dedup_scheduled_runs(df, ["seq"])
    assert rows(got, "run_id", "created", "actual_run_id") == [
        ("manual-g-1", True, "manual-g-1"), ("manual-g-2", True, "manual-g-2"), ("other", True, "other"),
        ("scheduled-g-20260606T120000", False, "other"), ("third", False, "other"),
    ]


def test_a_tie_has_one_creator(spark):
    at = dt.datetime(2026, 6, 6, 12)
    df = spark.createDataFrame(
        [("g", at, "b", 1), ("g", at, "a", 1), ("g", at, "c", 1)], "dag_id string, logical_date timestamp_ntz, run_id string, seq int"
    )
    got = windows.dedup_scheduled_runs(df, ["seq"])
    assert rows(got, "run_id", "created", "actual_run_id") == [("a", True, "a"), ("b", False, "a"), ("c", False, "a")]


def test_a_map_decides_a_tie(spark):
    df = spark.createDataFrame(
        [("d", "r", "t", 1, {"k": "1"}), ("d", "r", "t", 1, {"k": "2"})],
        "dag_id string, run_id string, task_id string, seq int, outputs map<string,string>",
    )
    assert windows.current_states(df, ["seq"]).first()["outputs"] == {"k": "2"}


def test_first_claimer_wins(spark):
    df = spark.createDataFrame(
        [("t", "b", 2), ("t", "a", 1), ("u", "b", 3)], "trigger_id string, instance_id string, claimed_at int"
    )
    assert rows(windows.claim_triggers(df, ["claimed_at"]), "trigger_id", "claimed_by") == [("t", "a"), ("u", "b")]


def test_admission_is_oldest_first(spark):
    day = [dt.datetime(2026, 1, d) for d in range(1, 5)]
    ticks = spark.createDataFrame(
        [("a", t) for t in day] + [("b", day[0])], "deployment_id string, logical_date timestamp_ntz"
    )
    deps = spark.createDataFrame([("a", 3), ("b", None)], "id string, max_active_runs int")
    active = spark.createDataFrame([("a", 1), ("b", 9)], "deployment_id string, active_runs long")
    got = windows.admit_under_limit(ticks, deps, active)
    assert rows(got.filter("admitted"), "deployment_id", "logical_date") == [("a", day[0]), ("a", day[1]), ("b", day[0])]
    assert rows(windows.deferred_counts(got)) == [("a", 2, 2), ("b", 1, 0)]


def test_transitions(spark):
    states = ["none", "scheduled", "queued", "running", "up_for_retry", "queued", "success"]
    df = spark.createDataFrame(
        [("d", "r", "t", s, i) for i, s in enumerate(states)],
        "dag_id string, run_id string, task_id string, state string, seq long",
    )
    bad = windows.audit_transitions(df, ["seq"]).filter("NOT is_legal")
    assert rows(bad, "from_state", "to_state") == [("queued", "success")]


def test_rows_with_maps_are_compacted_too(spark):
    df = spark.createDataFrame(
        [("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("b", 1, None)], "id string, seq int, labels map<string,string>"
    )
    assert rows(windows.current_states(df, ["seq"], ["id"])) == [("a", 2, {"x": "2"}), ("b", 1, None)]
