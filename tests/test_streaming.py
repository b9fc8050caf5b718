"""Streams run to the end of what is there and compared with their batch forms."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlens.operators import windows
from runlens.plans.views import History
from runlens.streaming import claims, sources, tables, zombies


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def staged(spark, df, path, files=3):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture(scope="module")
def history(spark, folder):
    return History(spark, folder)


def test_state_table_follows_the_stream(spark, history, tmp_path):
    order = ["updated_at", "seq1", "seq2", "seq3"]
    events = history.fx_task_events
    stream = staged(spark, events, tmp_path / "in")
    table = str(tmp_path / "table")
    query = tables.stream_current_states(
        stream, table, str(tmp_path / "cp"), windows.TASK_KEY, order, buckets=3, once=True
    )
    query.awaitTermination(240)
    want = windows.current_states(events, order)
    got = tables.read_current_states(spark, table)
    assert rows(got, "run_id", "task_id", "state") == rows(want, "run_id", "task_id", "state")


def test_first_claims(spark, history, tmp_path):
    """The winners are those of the batch operator, in whatever order the claims arrive."""
    late_first = history.fx_claims.orderBy(F.desc("claimed_at"))
    stream = staged(spark, late_first, tmp_path / "in", 3)
    table = str(tmp_path / "claims")
    query = claims.stream_claims(stream, table, str(tmp_path / "cp"), ("claimed_at", "seq"), buckets=3, once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    want = windows.claim_triggers(history.fx_claims, ["claimed_at", "seq"])
    got = tables.read_current_states(spark, table)
    assert rows(got, "trigger_id", "instance_id", "claimed_at") == rows(want, "trigger_id", "claimed_by", "claimed_at")


def test_a_new_checkpoint_goes_on_with_the_table(spark, tmp_path):
    table, order = str(tmp_path / "table"), ["at"]

    def run(name, state, at):
        df = spark.createDataFrame([("k", state, at)], "key string, state string, at int")
        stream = staged(spark, df, tmp_path / f"in-{name}", 1)
        tables.stream_current_states(stream, table, str(tmp_path / f"cp-{name}"), ["key"], order, 2, once=True).awaitTermination(240)
        return [r.state for r in tables.read_current_states(spark, table).collect()]

    assert run("a", "running", 1) == ["running"]
    assert run("b", "success", 2) == ["success"]
    assert run("c", "queued", 0) == ["success"]


def test_a_batch_is_shuffled_once(spark, tmp_path):
    """By bucket, for the choice and the writing; rows of a key that has most of a batch are thinned before."""
    plans = []

    def choose(found, keys):
        out = windows.current_states(found, ["at"], keys)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    data = [(f"k{i}", "even", i) for i in range(400)], [("k1", "hot", 1000 + i) for i in range(400)] + [("k2", "late", 0)]
    for n, lot in enumerate(data):
        stream = staged(spark, spark.createDataFrame(lot, "key string, state string, at int"), tmp_path / f"in-{n}", 1)
        tables.stream_winners(stream, str(tmp_path / "table"), str(tmp_path / f"cp-{n}"), ["key"], choose, 8, once=True).awaitTermination(240)
    assert len(plans) == 3  # the second batch is thinned first
    # the shuffles by bucket beside these are of one row per bucket and version
    assert [(p.count("REPARTITION_BY_COL"), p.count("Exchange hashpartitioning(key")) for p in plans] == [(1, 0), (0, 1), (1, 1)]
    got = dict(rows(tables.read_current_states(spark, str(tmp_path / "table")), "key", "state"))
    assert len(got) == 400 and got["k1"] == "hot" and got["k2"] == "even"


def test_a_table_that_cannot_be_read_is_an_error(spark, tmp_path):
    broken = tmp_path / "table" / "version=0" / "bucket=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|schema"):
        tables.read_current_states(spark, str(tmp_path / "table")).collect()
    assert tables._versions(spark, str(tmp_path / "none")) is None


def test_first_runs(spark, history, tmp_path):
    """One row per dated second, and every manual run."""
    candidates = history.fx_candidates
    got = drain(claims.stream_run_dedup(staged(spark, candidates, tmp_path / "in", 1)), "runs")
    dated = candidates.filter("logical_date IS NOT NULL").select("dag_id", "logical_date").distinct()
    assert rows(got.filter("logical_date IS NOT NULL"), "dag_id", "logical_date") == rows(dated)
    manual = candidates.filter("logical_date IS NULL").select("dag_id", "run_id").distinct()
    assert rows(got.filter("logical_date IS NULL"), "dag_id", "run_id") == rows(manual)


def test_zombies_match_the_batch_form(spark, tmp_path):
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    start = dt.datetime(2026, 1, 1)
    beats = []
    for task in range(6):
        for n, minute in enumerate((0, 1, 2, 10, 11, 30 + task)):
            kind = "terminal" if (task, n) == (2, 2) else "beat"
            beats.append((task, start + dt.timedelta(minutes=minute), n, kind))
    closing = [(99, start + dt.timedelta(hours=9), 1, "terminal")]
    schema = "task_key long, beat_at timestamp, seq long, kind string"
    first = spark.createDataFrame(beats, schema)
    path = tmp_path / "in"
    first.coalesce(1).write.parquet(str(path))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    spark.createDataFrame(closing, schema).coalesce(1).write.mode("append").parquet(str(path))
    try:
        found = stream.selectExpr("CAST(task_key AS STRING) task_key", "beat_at", "seq", "kind")
        got = drain(zombies.stream_zombies(found, 300), "zombies")
        pauses = rows(got, "task_key", "last_beat")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = rows(
        zombies.silences(first, 300, F.lit(start)).select(F.col("task_key").cast("string").alias("task_key"), "last_beat")
    )
    # The stream also sees that every task stays silent after its last beat.
    last = [(str(t), start + dt.timedelta(minutes=30 + t)) for t in range(6)]
    assert pauses == sorted([*want, *last], key=repr)


def test_late_beats_move_nothing_back(spark, tmp_path):
    """A beat from before the newest one, or from before the end, neither opens a pause nor wakes the task."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    start = dt.datetime(2026, 1, 1)
    schema = "task_key string, beat_at timestamp, seq long, kind string"
    files = (
        [("a", 8, "beat"), ("b", 1, "beat"), ("b", 3, "terminal")],
        [("a", 2, "beat"), ("b", 2, "beat")],
        [("a", 12, "terminal")],
        [("z", 600, "terminal")], [("z", 601, "terminal")],
    )
    path = str(tmp_path / "in")
    for n, beats in enumerate(files):
        made = [(k, start + dt.timedelta(minutes=m), n, kind) for k, m, kind in beats]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    try:
        got = drain(zombies.stream_zombies(stream, 300, "1 hour"), "late_beats")
        assert got.count() == 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_alerts_and_hooks(spark, history, tmp_path):
    events = history.fx_task_events.select("dag_id", "run_id", "task_id", "state", "updated_at")
    hooks = history.fx_dags.select("dag_id", F.lit("failure").alias("event"), F.lit("json-file").alias("hook"))
    out = str(tmp_path / "alerts")
    tables.stream_alerts(
        staged(spark, events, tmp_path / "in"), hooks, out, str(tmp_path / "cp")
    ).awaitTermination(240)
    assert spark.read.json(out).count() == events.filter("state = 'failed'").count()

    seen, errors = [], []

    def broken(batch, number):
        errors.append(number)
        raise RuntimeError("hook")

    query = tables.on_batch(
        tables.lifecycle_events(staged(spark, events, tmp_path / "in2", 1)),
        [broken, lambda batch, number: seen.append(batch.count())], str(tmp_path / "cp2"),
    )
    with pytest.raises(Exception, match="hook"):
        query.awaitTermination(240)
    assert errors and seen == [tables.lifecycle_events(events).count()]


def test_logs_stream_and_tail(spark, history, tmp_path):
    tags = F.when(
        F.col("source") == "task",
        F.struct("dag_id", "run_id", "task_id", F.col("attempt").cast("int").alias("attempt")),
    )
    raw = history.fx_logs.select(
        F.col("seq").cast("double").alias("ts"), "level", "msg", tags.alias("tags"),
        F.create_map(F.lit("props"), F.col("extra"), F.lit("name"), F.lit("x")).alias("attributes"),
    )
    out = str(tmp_path / "logs")
    tables.stream_logs(staged(spark, raw, tmp_path / "in"), out, str(tmp_path / "cp")).awaitTermination(240)
    lines = spark.read.option("recursiveFileLookup", True).json(out)
    assert lines.count() == raw.count()
    kept = lines.filter("source = 'task'").first()
    assert set(json.loads(kept["extra"])) == {"props"}

    one = lines.filter("source = 'task' AND attempt = 2").first()
    follow = sources.tail(
        spark.readStream.schema(lines.schema).option("recursiveFileLookup", True).json(out),
        one["dag_id"], one["run_id"], one["task_id"], 2,
    )
    same = (F.col("dag_id") == one["dag_id"]) & (F.col("run_id") == one["run_id"]) & (F.col("task_id") == one["task_id"])
    assert drain(follow, "tail").count() == lines.filter(same & (F.col("attempt") == 2)).count()


def test_record_files_as_stream(spark, tmp_path):
    folder = tmp_path / "runs" / "dag_id=g"
    folder.mkdir(parents=True)
    (folder / "r.json").write_text(json.dumps({"run_id": "r", "dag_id": "g", "state": "running"}, indent=2))
    got = drain(sources.stream_source(spark, "dag_runs", str(tmp_path / "runs"), 1), "records")
    assert rows(got, "run_id", "dag_id", "state") == [("r", "g", "running")]


def test_retries_have_a_due_time(spark):
    ended = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame(
        [("d", "r", "a", [(1, "failed", ended), (2, "failed", ended)], 2, 10, True),
         ("d", "r", "b", [(1, "failed", ended)], 0, 10, True), ("d", "r", "c", [(1, "success", ended)], 5, 10, True)],
        "dag_id string, run_id string, task_id string, attempts array<struct<attempt_number:int,state:string,ended_at:timestamp_ntz>>, "
        "retries int, retry_delay int, exponential_backoff boolean",
    )
    assert rows(tables.stream_retries(df), "task_id", "attempts_made", "due_at") == [("a", 2, ended + dt.timedelta(seconds=20))]
