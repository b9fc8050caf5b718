"""Rates, metrics, replayed streams, foreach, retention, writers and readers that forgive."""

import datetime as dt
import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlens.functions import blocks
from runlens.operators import foreach, graph, metrics, retention, rules
from runlens.sources import documents, records, sinks
from runlens.session import scratch
from runlens.streaming import claims, rates, replay, tables, zombies

DAY = dt.datetime(2026, 1, 1)


def seconds(n):
    return DAY + dt.timedelta(seconds=n)


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(2)
    data = [(seconds(rng.randrange(4000)), rng.choice(["INFO", "ERROR"]), rng.choice(["task", "framework"]), n % 3) for n in range(400)]
    return data + [(None, "INFO", "task", 0)]


def frame(spark, lines):
    return spark.createDataFrame(lines, "ts timestamp_ntz, level string, source string, lot int")


def counted(lines, width, slide):
    out, base = Counter(), dt.datetime(1970, 1, 1)
    for at, level, source, _ in lines:
        if at is None:
            continue
        s = int((at - base).total_seconds())
        start = s - s % slide
        while start > s - width:
            out[base + dt.timedelta(seconds=start), level, source] += 1
            start -= slide
    return out


@pytest.mark.parametrize("width, slide", [(60, None), (60, 20), (90, 60), (100, 100), (7, 3)])
def test_log_rates(spark, lines, width, slide):
    got = rates.log_rates(frame(spark, lines), width, slide).collect()
    want = counted(lines, width, slide or width)
    assert {(r.window_start, r.level, r.source): r.lines for r in got} == want and len(got) == len(want)
    assert all(r.window_end - r.window_start == dt.timedelta(seconds=width) for r in got)


def test_slides_longer_than_the_width_are_refused(spark, lines):
    with pytest.raises(ValueError):
        rates.log_rates(frame(spark, lines), 60, 90)


def test_streamed_rates_are_those_of_the_closed_windows(spark, lines):
    ordered = sorted((x for x in lines if x[0]), key=lambda x: x[0])
    df = frame(spark, [(a, b, c, i * 3 // len(ordered)) for i, (a, b, c, _) in enumerate(ordered)])
    got = replay.replayed(df, F.col("lot"), 3, lambda s: rates.stream_log_rates(s, 300, 100, "10 seconds"))
    mark = ordered[-1][0] - dt.timedelta(seconds=10)
    want = {k: n for k, n in counted(lines, 300, 100).items() if k[0] + dt.timedelta(seconds=300) <= mark}
    assert {(r.window_start, r.level, r.source): r.lines for r in got.collect()} == want


def test_a_replay_writes_its_rows_once(spark):
    seen, df = [], spark.range(100).withColumn("lot", F.when(F.col("id") < 90, F.col("id") % 3))
    folders = set(Path(scratch(spark).removeprefix("file:")).glob("*"))

    def start(stream, checkpoint):
        return stream.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.id for r in b.collect()))).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replay.replay(df, F.col("lot") * 2, 5, start)  # lots 1 and 3 are empty
    assert [x for x in seen if x] == [list(range(i, 90, 3)) for i in range(3)]
    made = set(Path(scratch(spark).removeprefix("file:")).glob("*")) - folders
    files = [str(p) for folder in made for p in folder.rglob("*.parquet")]
    assert spark.read.parquet(*files).count() == 90


def test_late_lines_are_counted_apart(spark, tmp_path):
    """A line is late for a window that the watermark has passed, and in time for a later one; a repeated read is the same."""
    data = [
        (seconds(10), "INFO", "task", 0), (seconds(100), "INFO", "task", 0),
        (seconds(20), "INFO", "task", 1), (seconds(95), "INFO", "task", 1), (seconds(400), "INFO", "task", 1),
        (seconds(390), "INFO", "task", 2), (seconds(15), "INFO", "task", 2),
    ]
    table = str(tmp_path / "rates")
    replay.replay(
        frame(spark, data), F.col("lot"), 3, lambda s, checkpoint: rates.keep_log_rates(s, table, checkpoint, 30, 30, once=True)
    )
    got = {r.window_start: (r.lines, r.late_lines, r.closed) for r in rates.read_log_rates(spark, table, 60, 30, 30, 30).collect()}
    # before lot 1 the watermark is 70, before lot 2 it is 370, at the end 370
    assert got == {
        seconds(-30): (1, 2, True), seconds(0): (1, 2, True), seconds(60): (2, 0, True), seconds(90): (2, 0, True),
        seconds(360): (2, 0, False), seconds(390): (2, 0, False),
    }
    with pytest.raises(ValueError):
        rates.read_log_rates(spark, table, 50, 50, 30)


def test_durations(spark):
    rng = random.Random(4)
    values = [rng.expovariate(1 / 40) for _ in range(20_000)] + [0.5, 1.0, 300.0, 9999.0]
    df = spark.createDataFrame([("a" if i % 3 else "b", v, i % 7) for i, v in enumerate(values)] + [("c", None, 0)], "state string, duration double, day int")
    got = {(r.state, r.le): r.n for r in metrics.duration_histogram(df).collect()}
    for state in "ab":
        own = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == state]
        for le in (*metrics.DURATION_BOUNDS, None):
            assert got.pop((state, le)) == sum(le is None or v <= le for v in own)
    assert not got
    merged = metrics.merge_sketches(metrics.duration_sketches(df, ["state", "day"]), ["state"])
    for r in metrics.quantiles(merged, ["state"], (0.1, 0.5, 0.99)).collect():
        own = sorted(v for i, v in enumerate(values) if ("a" if i % 3 else "b") == r.state)
        assert r.n == len(own)
        assert abs(sum(v <= r.quantile for v in own) / len(own) - r.share) <= metrics.RANK_ERROR


def test_queue_depth(spark):
    rng = random.Random(6)
    spans = []
    for n in range(600):
        start = rng.randrange(5000)
        spans.append(("q" if n % 3 else "r", seconds(start), rng.choice([None, seconds(start + rng.randrange(900))])))
    odd = [("q", None, seconds(3)), ("q", seconds(50), seconds(20)), ("r", seconds(7), seconds(7))]
    got = metrics.queue_depth(spark.createDataFrame(spans + odd, "queue string, queued_at timestamp_ntz, ended_at timestamp_ntz"), step=600)
    changes = defaultdict(Counter)
    for queue, start, end in [*spans, odd[2]]:
        changes[queue][start] += 1
        if end:
            changes[queue][end] -= 1
    want = []
    for queue, at in changes.items():
        depth, steps = 0, {}
        for moment in sorted(at):
            step = seconds(int((moment - DAY).total_seconds()) // 600 * 600)
            steps.setdefault(step, [depth, depth])
            depth += at[moment]
            steps[step] = [max(steps[step][0], depth), depth]
        want += [(queue, step, peak, last) for step, (peak, last) in steps.items()]
    assert rows(got, "queue", "at", "peak", "depth") == sorted(want, key=repr)


def test_a_run_that_comes_late_is_created_once(spark):
    """A rival a day behind everything seen is refused, a late first candidate of its own date is not."""
    data = [
        ("g", DAY, "r1", seconds(0), 0), ("g", seconds(86400 * 9), "r2", seconds(86400 * 9), 0), ("g", None, "m1", seconds(1), 0),
        ("g", DAY, "r3", seconds(-86400), 1), ("g", seconds(60), "r4", seconds(-86400), 1), ("g", None, "m1", seconds(1), 1),
        ("h", DAY, "r5", seconds(5), 2), ("g", seconds(60) + dt.timedelta(microseconds=5), "r6", seconds(5), 2),
        ("g", DAY, "r7", seconds(86400 * 30), 2),
    ]
    df = spark.createDataFrame(data, "dag_id string, logical_date timestamp_ntz, run_id string, created_at timestamp_ntz, lot int")
    with replay.state_on_disk(spark):
        got = replay.replayed(df, F.col("lot"), 3, claims.stream_run_dedup)
    assert sorted(r.run_id for r in got.collect()) == ["m1", "m1", "r1", "r2", "r4", "r5"]


def test_ended_tasks_hold_no_state(spark, monkeypatch):
    """The end of a task is kept until the watermark has passed it: a late beat does not revive the task."""
    data = [
        (seconds(0), 1, "beat", "a", 0), (seconds(10), 2, "terminal", "a", 0), (seconds(20), 3, "beat", "b", 0),
        (seconds(5), 4, "beat", "a", 1), (seconds(25), 5, "beat", "b", 1),
        (seconds(9000), 6, "beat", "c", 2), (seconds(9500), 7, "beat", "a", 3), (seconds(20000), 8, "terminal", "z", 3),
    ]
    df = spark.createDataFrame(data, "beat_at timestamp_ntz, seq long, kind string, task_key string, lot int")
    with replay.state_on_disk(spark):
        got = replay.replayed(df, F.col("lot"), 4, lambda s: zombies.stream_zombies(s, 300, "1 hour"))
    assert sorted((r.task_key, r.last_beat) for r in got.collect()) == [("a", seconds(9500)), ("b", seconds(25)), ("c", seconds(9000))]


def test_foreach(spark):
    items = ['["x", null, {"k": [1]}, 4]', "[]", None, '{"a": 1}', "[1, 2", " [true]", "7"]
    df = spark.createDataFrame([("g", f"r{i}", "t", x) for i, x in enumerate(items)], "dag_id string, run_id string, task_id string, items string")
    got = rows(foreach.expand_foreach(df), "run_id", "item_index", "instance_id", "item")
    assert got == [
        ("r0", 0, "t[0]", "x"), ("r0", 1, "t[1]", None), ("r0", 2, "t[2]", '{"k":[1]}'), ("r0", 3, "t[3]", "4"), ("r5", 0, "t[0]", "true"),
    ]
    assert rows(foreach.foreach_problems(df), "run_id", "problem") == [
        ("r2", "no_items"), ("r3", "not_a_list"), ("r4", "not_a_list"), ("r6", "not_a_list"),
    ]
    out = spark.createDataFrame(
        [("g", "r0", "t", 2, "c"), ("g", "r0", "t", 0, "a"), ("g", "r0", "t", 0, "A"), ("g", "r0", "t", 9, "z"), ("g", "r1", "t", 0, "y")],
        "dag_id string, run_id string, task_id string, item_index int, output string",
    )
    gathered = foreach.gather_outputs(df, out)
    assert rows(gathered, "run_id", "outputs", "missing") == [("r0", ["a", None, "c", None], 2), ("r1", [], 0), ("r5", [None], 1)]
    edges = spark.createDataFrame([("g", "t", "u"), ("g", "t", "u"), ("g", "x", "u"), ("h", "t", "v")], "dag_id string, upstream string, downstream string")
    assert rows(foreach.downstream_lists(gathered, edges), "run_id", "task_id", "upstream")[0] == ("r0", "u", "t")
    states = spark.createDataFrame(
        [("g", "r0", "t", i, s) for i, s in enumerate(["success", "failed", "skipped", "success"])] + [("g", "r5", "t", 0, "running")],
        "dag_id string, run_id string, task_id string, item_index int, state string",
    )
    assert rows(foreach.foreach_states(df, states), "run_id", "state") == [("r0", "failed"), ("r1", "skipped"), ("r5", "running")]


RUNS = [
    ("a", "r1", "success", seconds(-86400 * 50)), ("a", "r2", "failed", seconds(-86400 * 31)), ("b", "r3", "success", seconds(-86400 * 40)),
    ("b", "r4", "running", None), ("b", "r5", "running", seconds(-86400 * 90)), ("c", "r6", "success", seconds(-86400 * 29)),
    (None, "r7", "success", seconds(-86400 * 99)), ("d/e=f", "r8", "success", seconds(-86400 * 99)), ("a", "r9", "success", seconds(-86400 * 33)),
]


def test_purge(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.createDataFrame(RUNS, "dag_id string, run_id string, state string, ended_at timestamp_ntz")
    runs.write.partitionBy("dag_id").parquet(path)
    expired = retention.run_expired(F.lit(DAY).cast("timestamp_ntz"), 30)
    files = sorted(p.name for p in Path(path).rglob("*.parquet"))
    dry = retention.purge_table(spark, path, ["dag_id"], expired)
    want = [("a", 0, 3, "drop"), ("b", 2, 1, "rewrite"), ("c", 1, 0, "keep"), ("d/e=f", 0, 1, "drop"), (None, 0, 1, "drop")]
    assert rows(dry, "dag_id", "kept", "purged", "action") == sorted(want, key=repr)
    assert sorted(p.name for p in Path(path).rglob("*.parquet")) == files
    untouched = [p.name for p in Path(path, "dag_id=c").glob("*.parquet")]
    retention.purge_table(spark, path, ["dag_id"], expired, dry_run=False)
    assert rows(spark.read.parquet(path), "run_id") == [("r4",), ("r5",), ("r6",)]
    assert sorted(p.name for p in Path(path).glob("dag_id=*")) == ["dag_id=b", "dag_id=c"]
    assert [p.name for p in Path(path, "dag_id=c").glob("*.parquet")] == untouched
    gone = retention.purge_runs(runs, F.lit(DAY).cast("timestamp_ntz"), 30)
    records_ = spark.createDataFrame([("a", "r1", 1), ("b", "r4", 2)], "dag_id string, run_id string, n int")
    assert rows(retention.purge_records(records_, gone), "n") == [(2,)]


def test_expire_logs(spark, tmp_path):
    path = str(tmp_path / "logs")
    days = spark.createDataFrame([(f"2026-01-{d:02d}", d) for d in range(1, 11)], "day string, n int")
    days.write.partitionBy("day").parquet(path)
    (tmp_path / "logs" / "day=soon").mkdir()
    (tmp_path / "logs" / "other").mkdir()
    gone = retention.expire_logs(spark, path, "2026-01-10", 3)
    assert gone == [f"day=2026-01-{d:02d}" for d in range(1, 7)] and spark.read.parquet(path).count() == 10
    retention.expire_logs(spark, path, "2026-01-10", 3, dry_run=False)
    left = sorted(p.name for p in (tmp_path / "logs").glob("*") if p.is_dir())
    assert left == ["day=2026-01-07", "day=2026-01-08", "day=2026-01-09", "day=2026-01-10", "day=soon", "other"]


def attempts(spark, n):
    """Two lines for each of n attempts, over two days, and one noisy attempt that writes a third of all."""
    quiet = spark.range(2 * n).selectExpr(
        "TIMESTAMP_NTZ '2026-01-01' + make_dt_interval(0, 0, 0, id % 172800) AS ts", "'INFO' AS level", "concat('m', id) AS msg",
        "'task' AS source", "concat('d', id % 100) AS dag_id", "concat('r', floor(id / 2) % 5000) AS run_id",
        "concat('t', floor(id / 10000)) AS task_id", "cast(1 AS int) AS attempt",
    )
    noisy = spark.range(n).selectExpr(
        "TIMESTAMP_NTZ '2026-01-01' AS ts", "'INFO' AS level", "concat('n', id) AS msg", "'task' AS source", "'hot' AS dag_id",
        "'hot' AS run_id", "'hot' AS task_id", "cast(2 AS int) AS attempt",
    )
    return quiet.unionByName(noisy)


def test_log_table_has_few_folders_and_files_of_a_size(spark, tmp_path):
    path, logs = str(tmp_path / "table"), attempts(spark, 50_000)
    sinks.write_log_table(logs, path, buckets=4, file_bytes=1 << 20)
    folders = {p.parent for p in (tmp_path / "table").rglob("*.parquet")}
    files = list((tmp_path / "table").rglob("*.parquet"))
    assert len(folders) == 8 and 8 <= len(files) <= 20
    per_folder = Counter(p.parent for p in files)
    assert max(per_folder.values()) >= 4  # the bucket of the noisy attempt is split
    assert max(p.stat().st_size for p in files) < 4 * min(p.stat().st_size for p in files if per_folder[p.parent] > 1) + (1 << 20)
    back = sinks.read_log_table(spark, path, "hot", "hot", "hot", 2, 4)
    assert back.count() == 50_000 and back.select("bucket").distinct().count() == 1
    one = sinks.read_log_table(spark, path, "d4", "r2", "t0", 1, 4)
    assert rows(one, "msg") == rows(logs.filter("dag_id = 'd4' AND run_id = 'r2' AND task_id = 't0'"), "msg")
    assert spark.read.parquet(path).count() == 150_000
    sinks.write_log_table(logs.limit(0), path)


def test_a_batch_of_logs_written_twice_counts_once(spark, tmp_path):
    path, logs = str(tmp_path / "table"), attempts(spark, 50)
    for _ in range(2):
        sinks.write_log_table(logs, path, 2, batch=7)
    assert spark.read.parquet(path).count() == 150
    table = str(tmp_path / "streamed")
    replay.replay(
        logs, F.pmod(F.xxhash64("msg"), F.lit(2)), 2, lambda s, checkpoint: tables.stream_log_table(s, table, checkpoint, 2, once=True)
    )
    assert rows(spark.read.parquet(table), "msg") == rows(logs, "msg")


def test_partitions_are_written_by_size(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.range(10_000).selectExpr("if(id < 9000, 'hot', concat('k', id % 3)) AS key", "id AS v")
    sinks.write_partitions(df, path, ["key"], rows_per_file=2000)
    files = Counter(p.parent.name for p in (tmp_path / "snap").rglob("*.parquet"))
    assert 3 <= files["key=hot"] <= 5 and all(files[f"key=k{i}"] == 1 for i in range(3))
    sinks.write_partitions(spark.createDataFrame([("k0", 7)], "key string, v long"), path, ["key"])
    assert spark.read.parquet(path).filter("key = 'k0'").count() == 1 and spark.read.parquet(path).filter("key = 'hot'").count() == 9000


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_one_bad_document_gives_one_error_row(spark, tmp_path):
    put(tmp_path / "a.yml", "id: a\nactions: [{id: t}]\n---\nid: b\nactions: [{uses: py}]\n---\nid: c\nactions: [{id: u}]\n")
    put(tmp_path / "b.yml", "id: [")
    put(tmp_path / "c.yml", "actions: []")
    put(tmp_path / "d.yml", "")
    put(tmp_path / "variables.yml", "- a\n- b")
    put(tmp_path / "x" / "variables.yml", "k: {")
    put(tmp_path / "y" / "variables.yml", "k: 1")
    assert rows(documents.read_dag_documents(spark, str(tmp_path)), "dag_id", "task_id") == [("a", "t"), ("c", "u")]
    errors = [(r.path.rsplit("/", 1)[1], r.reason) for r in documents.dag_document_errors(spark, str(tmp_path)).collect()]
    assert sorted(errors) == [("a.yml", "bad_action"), ("b.yml", "not_yaml"), ("c.yml", "no_dag_id")]
    assert rows(documents.read_variable_files(spark, str(tmp_path)), "var_key", "var_value") == [("k", "1")]
    wrong = [r.reason for r in documents.variable_file_errors(spark, str(tmp_path)).collect()]
    assert sorted(wrong) == ["not_a_mapping", "not_yaml"]


def test_record_files_that_cannot_be_read(spark, tmp_path):
    put(tmp_path / "runs" / "1.json", json.dumps({"run_id": "r", "dag_id": "g"}))
    put(tmp_path / "runs" / "2.json", '{"run_id": ')
    put(tmp_path / "runs" / "3.json", json.dumps({"run_id": "r", "created_at": "soon"}))
    found = [(r.path[-6:], r.reason) for r in records.record_errors(spark, str(tmp_path / "runs"), "dag_runs").collect()]
    assert sorted(found) == [("2.json", "not_json"), ("3.json", "bad_value")]
    put(tmp_path / "logs" / "f.jsonl", '{"ts": 1.5, "msg": "a"}\n\nTraceback\n{"msg": "b"}\n')
    assert [r.reason for r in records.record_errors(spark, str(tmp_path / "logs"), "logs").collect()] == ["not_json"]


def reach(edges, seeds):
    out = {}
    for graph_, root in seeds:
        frontier, depth = [root], 0
        out[graph_, root, root] = 0
        while frontier:
            depth += 1
            frontier = [d for g, u, d in edges if g == graph_ and u in frontier and (graph_, root, d) not in out]
            frontier = list(dict.fromkeys(frontier))
            out.update({(graph_, root, d): depth for d in frontier})
    return out


def test_descendants_with_cycles(spark):
    rng = random.Random(9)
    edges = []
    for g in "xyz":
        for _ in range(40):
            a, b = rng.randrange(20), rng.randrange(20)
            if g == "x":
                a, b = min(a, b), max(a, b) + 1
            edges.append((g, f"n{a}", f"n{b}"))
    seeds = [("x", "n0"), ("x", "n3"), ("y", "n1"), ("y", "n7"), ("z", "n2"), ("z", "alone"), ("w", "n0"), ("x", "n0")]
    got = graph.descendants(
        spark.createDataFrame(edges, "dag_id string, upstream string, downstream string"), spark.createDataFrame(seeds, "dag_id string, root string")
    )
    assert {(r.dag_id, r.root, r.node): r.depth for r in got.collect()} == reach(edges, seeds)
    assert got.count() == len(reach(edges, seeds))


def test_ranked_over_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.range(5000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id % 5)) AS k", "cast(id % 3 AS int) AS level", "id * 7919 % 5000 AS node")
        got = blocks.ranked(df, ["k"], ["level", "node"], "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    held = defaultdict(list)
    for r in got:
        held[r.k].append((r.level, r.node, r.place))
    for some in held.values():
        assert [p for *_, p in sorted(some)] == list(range(1, len(some) + 1))


def test_a_hot_dag_is_spread_in_rule_counts(spark):
    """One DAG holds half of all states: with broadcasts off no task joins more than twice its share."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        edges = spark.createDataFrame(
            [(f"d{i}", "t1", f"t{j}") for i in range(40) for j in (2, 3)] + [("hot", "t1", "t2")], "dag_id string, upstream string, downstream string"
        )
        states = spark.range(20_000).selectExpr(
            "if(id % 2 = 0, 'hot', concat('d', id % 39)) AS dag_id", "concat('r', id) AS run_id", "'t1' AS task_id", "'success' AS state"
        )
        counts = rules.upstream_counts(edges, states)
        # rows of the join by the task that made them, as the aggregate above it has them
        joined = rules.spread_join(
            states.select("dag_id", "run_id", F.col("task_id").alias("upstream"), "state"), edges, ["dag_id", "upstream"], copies=rules.EDGE_COPIES
        )
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = counts.select("dag_id", "run_id", "task_id", "n_success")
        n = plain.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert n == sum(sizes) == 10_000 + 20_000
    assert max(sizes) <= 2 * sum(sizes) / 8
