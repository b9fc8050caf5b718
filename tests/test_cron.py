"""Cron expansion against a brute-force scan of every minute."""

import calendar
import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlens.functions import cron as C
from runlens.operators import joins, schedule, windows
from runlens.sources.records import dag_requirements  # noqa: F401 - imports cleanly

NAMES = {name: i for i, name in enumerate(C.MONTH_NAMES, 1)} | {
    name: i for i, name in enumerate(C.WEEKDAY_NAMES)
}


def nearest_workday(at, asked):
    last = calendar.monthrange(at.year, at.month)[1]
    number = last if asked == "l" else int(asked)
    if number > last:
        return None
    day = at.replace(day=number)
    away = {5: -1, 6: 1}.get(day.weekday(), 0)
    if asked == "l" or not 1 <= number + away <= last:
        away = {5: -1 if number > 1 else 2, 6: -2 if number == last or asked == "l" else 1}.get(day.weekday(), 0)
    return number + away


def day_rule(item, at):
    last = calendar.monthrange(at.year, at.month)[1]
    return at.day == last if item == "l" else at.day == nearest_workday(at, item[:-1])


def weekday_rule(item, at):
    name = item.split("#")[0] if "#" in item else item.strip("l") if item != "l" else item
    same = at.isoweekday() % 7 == NAMES.get(name, None if name in NAMES else int(name) % 7)
    last = calendar.monthrange(at.year, at.month)[1]
    return same and ((at.day - 1) // 7 + 1 == int(item[-1]) if "#" in item else at.day > last - 7)


def parted(text, ruled):
    items = text.lower().split(",")
    return ",".join(i for i in items if not ruled(i)), [i for i in items if ruled(i)]


def values(text, low, high):
    out = set()
    for item in text.lower().split(",") if text else ():
        base, _, step = item.partition("/")
        if base in "*?":
            start, end = low, high
        else:
            ends = [NAMES.get(p, None) if p in NAMES else int(p) for p in base.split("-")]
            start = ends[0]
            end = ends[1] if len(ends) == 2 else (high if step else start)
        out |= set(range(start, end + 1, int(step or 1)))
    return out


def fires(text, at):
    minute, hour, mday, month, wday, *seconds = text.split()
    days, day_rules = parted(mday, lambda i: i.endswith(("l", "w")))
    weekdays, week_rules = parted(wday, lambda i: "#" in i or i.startswith("l") or i.endswith("l"))
    by_day = at.day in values(days, 1, 31) or any(day_rule(i, at) for i in day_rules)
    by_week = (at.isoweekday() % 7) in {v % 7 for v in values(weekdays, 0, 7)} or any(weekday_rule(i, at) for i in week_rules)
    both = mday not in "*?" and wday not in "*?"
    day = (by_day or by_week) if both else (by_day and by_week)
    return (
        at.second in values(seconds[0] if seconds else "0", 0, 59)
        and at.minute in values(minute, 0, 59) and at.hour in values(hour, 0, 23)
        and at.month in values(month, 1, 12) and day
    )


CRONS = [
    "0 0 * * *", "*/15 * * * *", "5-20/5 1,13 * * *", "0 6 * * 1-5", "30 2 1 * *",
    "15 3 1,15 * 1", "0 0 * feb-mar mon,fri", "10/20 4 * * 7", "0 12 31 * *", "0 0 */10 * *",
    "0 0 29 2 *", "7 7 * JAN sun", "0 0 ? * *", "59 23 * 12 0-6/3",
    "0 0 L * *", "5 4 * * L5", "5 4 * * 5L", "0 8 15W * *", "0 8 LW * *", "0 8 1W,28W * *", "0 0 31W * *",
    "0 9 * * mon#1,fri#3", "0 0 L,10 * 3#2", "0 0 * * 7#4", "0 12 L feb *",
]
SECONDS = ["* * * * * 30", "*/30 4 * * * 0,20-40/10", "0 0 1 * * 59", "59 23 L * * 59"]


@pytest.fixture(scope="module")
def deployments(spark):
    return spark.createDataFrame(
        [(f"d{i}", text) for i, text in enumerate(CRONS)], "id string, cron string"
    )


def test_ticks_match_every_minute(spark, deployments):
    start, end = dt.datetime(2024, 1, 28, 22, 30), dt.datetime(2024, 3, 5, 4, 45)
    got = schedule.cron_ticks(
        deployments, F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    )
    found = {}
    for row in got.collect():
        found.setdefault(row["deployment_id"], []).append(row["logical_date"])
    minutes = int((end - start).total_seconds() // 60)
    for i, text in enumerate(CRONS):
        want = [t for m in range(minutes + 1) if fires(text, t := start + dt.timedelta(minutes=m))]
        assert sorted(found.get(f"d{i}", [])) == want, text


STATUSES = [
    ("0 0 * * *", "ok"), ("60 * * * *", "invalid"), ("* 24 * * *", "invalid"), ("* * 0 * *", "invalid"),
    ("* * * 13 *", "invalid"), ("* * * * 8", "invalid"), ("*/0 * * * *", "invalid"), ("a * * * *", "invalid"),
    ("5-1 * * * *", "invalid"), ("1-2-3 * * * *", "invalid"), ("* * * *", "invalid"), ("", "invalid"),
    ("0 0 * * wed", "ok"), ("@daily", "ok"), (" @Hourly ", "ok"), ("@reboot", "unsupported"), ("0 0 0 * * *", "invalid"), ("0 0 1 * * *", "ok"),
    ("0 0 L * *", "ok"), ("0 0 * * 5L", "ok"), ("0 0 * * mon#2", "ok"), ("0 0 LW,3 * L5,sun#1", "ok"),
    ("0 0 15W * *", "ok"), ("0 0 32W * *", "unsupported"), ("0 0 L-3 * *", "unsupported"), ("0 0 * * 1,5#3", "unsupported"),
    ("0 0 * * 5#6", "unsupported"), ("0 0 * * L", "unsupported"), ("* * * * * 60", "invalid"), ("* * * * * * 2026", "unsupported"),
    ("H 0 * * *", "unsupported"), ("L * * * *", "invalid"), ("0 0 L,40 * *", "invalid"), ("0 0 * jul *", "ok"), ("  0   0 * * * ", "ok"),
]


def test_status(spark):
    df = spark.createDataFrame(STATUSES, "cron string, wanted string")
    got = [(r["cron"], r["cron_status"]) for r in schedule.parse_cron(df).collect()]
    assert got == STATUSES


def _deps(spark, *deps):
    return spark.createDataFrame(
        list(deps),
        "id string, dag_id string, cron string, enabled boolean, catch_up boolean, last_scheduled_at timestamp_ntz, "
        "start_date timestamp_ntz, end_date timestamp_ntz, max_active_runs int",
    )


def test_catch_up_starts_with_the_start_date(spark):
    day = dt.datetime(2026, 1, 1)
    deps = _deps(
        spark,
        ("a", "g", "0 0 * * *", True, True, None, day + dt.timedelta(hours=5), None, None),
        ("b", "g", "0 0 * * *", True, True, None, day, day + dt.timedelta(days=1), None),
        ("c", "g", "0 0 * * *", True, True, day, day, None, None),
        ("d", "g", "0 0 * * *", True, False, None, day, None, None),
    )
    now = F.lit(dt.datetime(2026, 1, 3)).cast("timestamp_ntz")
    assert rows(schedule.catch_up_ticks(deps, now)) == [
        ("a", dt.datetime(2026, 1, 1, 5)), ("a", dt.datetime(2026, 1, 2)),
        ("b", dt.datetime(2026, 1, 1)), ("b", dt.datetime(2026, 1, 2)),
    ]


def test_due_tick_is_strictly_before_now(spark):
    day = dt.datetime(2026, 1, 1)
    deps = _deps(
        spark,
        ("a", "g", "0 0 * * *", True, False, None, day, None, None),
        ("b", "g", "0 0 * * *", True, False, dt.datetime(2026, 1, 2), day, None, None),
        ("c", "g", "0 0 * * *", False, False, None, day, None, None),
    )
    now = F.lit(dt.datetime(2026, 1, 3)).cast("timestamp_ntz")
    ticks = schedule.cron_ticks(deps, F.lit(day).cast("timestamp_ntz"), now)
    assert rows(joins.due_ticks(deps, ticks, now), "deployment_id", "due_at") == [("a", dt.datetime(2026, 1, 2))]


def test_backfill_counts(spark):
    deps = _deps(spark, ("d", "g", "0 0 * * *", True, False, None, None, None, None),
                 ("h", "g", "0 * * * *", True, False, None, None, None, None))
    span = [F.lit(t).cast("timestamp_ntz") for t in (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 5))]
    counts = {r[0]: r[1] for r in schedule.cron_ticks(deps, *span).groupBy("deployment_id").count().collect()}
    assert counts == {"d": 5, "h": 97}
    ticks = schedule.cron_ticks(deps, span[0], F.lit(dt.datetime(2026, 1, 1, 1)).cast("timestamp_ntz"), ("dag_id",))
    daily = ticks.filter("deployment_id = 'd'")
    known = spark.createDataFrame([("g", "backfill-g-20260101T000000")], "dag_id string, run_id string")
    assert rows(joins.plan_backfill(daily, known), "action") == [("skipped",)]
    assert rows(joins.plan_backfill(daily, known, reset=True), "action") == [("reset",)]
    assert rows(joins.plan_backfill(daily, known.filter("false")), "action") == [("new",)]


def test_intervals(spark):
    t = [dt.datetime(2026, 1, 1, h) for h in range(4)]
    ticks = spark.createDataFrame(
        [("a", "0 * * * *", t[0], None), ("a", "0 * * * *", t[1], t[3]), ("a", "0 * * * *", t[2], None), ("m", None, t[0], None)],
        "deployment_id string, cron string, logical_date timestamp_ntz, interval_end timestamp_ntz",
    )
    assert rows(windows.data_intervals(ticks), "deployment_id", "data_interval_start", "data_interval_end") == [
        ("a", t[0], t[1]), ("a", t[1], t[3]), ("a", t[2], t[3]), ("m", t[0], t[0]),
    ]


def test_seconds_match_every_second(spark):
    deps = spark.createDataFrame([(f"d{i}", text) for i, text in enumerate(SECONDS)], "id string, cron string")
    start, end = dt.datetime(2024, 1, 31, 23, 59, 10), dt.datetime(2024, 2, 1, 4, 40, 30)
    got = schedule.cron_ticks(deps, F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")).collect()
    for i, text in enumerate(SECONDS):
        seconds = int((end - start).total_seconds())
        want = [t for s in range(seconds + 1) if fires(text, t := start + dt.timedelta(seconds=s))]
        assert sorted(r.logical_date for r in got if r.deployment_id == f"d{i}") == want, text


def test_neighbours_by_search(spark):
    """The tick found is the nearest one that a scan of every day finds, over years, both ways."""
    rng = random.Random(5)
    crons = [*CRONS, *SECONDS, "0 0 29 2 1#1", "0 0 30 2 *", "* * * * *", "0 0 31 4,6 *", "0 0 31W 2 *"]
    day = dt.timedelta(days=1)
    begin, finish = dt.datetime(2023, 1, 1), dt.datetime(2029, 12, 31)
    ticks = {}
    for text in crons:  # days first, then the times of a day
        probe = [begin + day * n for n in range((finish - begin).days + 1)]
        minute, hour, mday, month, wday, *seconds = text.split()
        days = [d for d in probe if fires(f"0 0 {mday} {month} {wday}", d)]
        times = [
            dt.timedelta(hours=h, minutes=m, seconds=s)
            for h in values(hour, 0, 23) for m in values(minute, 0, 59) for s in values(seconds[0] if seconds else "0", 0, 59)
        ]
        ticks[text] = days, sorted(times)
    rows_, want = [], {}
    for i, text in enumerate(crons):
        days, times = ticks[text]
        for k in range(25):
            at = dt.datetime(2024, 2, 1) + dt.timedelta(seconds=rng.randrange(3 * 365 * 86400), microseconds=rng.choice((0, 0, 500_000)))
            if days and k % 2:
                at = rng.choice([d for d in days if d.year in (2024, 2025, 2026)] or days) + rng.choice(times) + dt.timedelta(seconds=rng.choice((-1, 0, 1)))
            midnight = at.replace(hour=0, minute=0, second=0, microsecond=0)
            near = [d for d in days if abs(d - midnight) <= 2000 * day]
            later = next((d + t for d in near if d >= midnight for t in times if d + t > at), None)
            sooner = next((d + t for d in reversed(near) if d <= midnight for t in reversed(times) if d + t < at), None)
            rows_.append((i * 100 + k, text, at))
            want[i * 100 + k] = later, sooner
    rows_ += [(-1, None, begin), (-2, "61 * * * *", begin), (-3, "@reboot", begin), (-4, "@daily", None)]
    df = spark.createDataFrame(rows_, "n int, cron string, at timestamp_ntz")
    both = schedule.neighbour_ticks(schedule.neighbour_ticks(df, F.col("at"), True, "later"), F.col("at"), False, "sooner")
    got = {r.n: (r.later, r.sooner) for r in both.collect()}
    assert [got.pop(-i) for i in range(1, 5)] == [(None, None)] * 4
    wrong = {n: (rows_[j][1:], got[n], want[n]) for j, (n, *_) in enumerate(rows_) if n >= 0 and got[n] != want[n]
             # a leap day may lie outside the years scanned
             and not ("29 2" in rows_[j][1] and None in want[n])}
    assert not wrong


def test_due_now_needs_no_ticks(spark):
    day = dt.datetime(2026, 1, 1)
    deps = _deps(
        spark,
        ("a", "g", "0 0 * * *", True, False, None, day, None, None),
        ("b", "g", "0 0 * * *", True, False, dt.datetime(2026, 1, 2), day, None, None),
        ("c", "g", "0 0 * * *", False, False, None, day, None, None),
        ("d", "g", "0 0 L * *", True, False, None, None, None, None),
        ("e", "g", "@reboot", True, False, None, None, None, None),
    )
    now = F.lit(dt.datetime(2026, 1, 3)).cast("timestamp_ntz")
    due = joins.due_now(deps, now)
    assert rows(due, "deployment_id", "due_at") == [("a", dt.datetime(2026, 1, 2)), ("d", dt.datetime(2025, 12, 31))]
    assert rows(schedule.unscheduled(deps), "deployment_id", "cron_status") == [("e", "unsupported")]


def test_ticks_of_a_small_table_are_made_by_many_tasks(spark):
    """A few rows hold many ticks: the rows are dealt before their days are searched, and a tick is copied once."""
    begin, end = dt.datetime(2026, 1, 1, 7, 59, 50), dt.datetime(2026, 1, 3, 8, 0, 5)
    deps = spark.createDataFrame([("a", "59,0 8,7 * * * 55,5"), ("a", "59,0 8,7 * * * 55,5"), (None, "0 8 * * *")], "id string, cron string").coalesce(1)
    ticks = schedule.cron_ticks(deps, F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    plan = ticks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(") == 3 and "RoundRobinPartitioning" in plan  # copies of the crons, days, times
    every = [dt.datetime(2026, 1, d, h, m, s) for d in (1, 2, 3) for h in (7, 8) for m in (0, 59) for s in (5, 55)]
    want = [("a", t) for t in every if begin <= t <= end] * 2 + [(None, dt.datetime(2026, 1, d, 8)) for d in (1, 2, 3)]
    assert rows(ticks) == sorted(want, key=repr)
