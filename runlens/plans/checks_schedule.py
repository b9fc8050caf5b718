"""Queries over schedules, variables, sources and streams in batch form."""

from pyspark.sql import functions as F

from runlens.functions import maps
from runlens.operators import aggregates, filters, joins, schedule, windows
from runlens.operators import variables as V
from runlens.plans import day
from runlens.plans.checks import NOW, check, moment
from runlens.sources import documents, records, sinks
from runlens.streaming import tables, zombies

FROM, UNTIL = "2024-01-01 00:00:00", NOW

# The seven crons of the deployments, spelled out over a minute series.
KIND = "dep_no % 8"
FITS = """CASE k.kind WHEN 0 THEN hour(t) = 0 AND minute(t) = 0 WHEN 1 THEN hour(t) = 2 AND minute(t) = 30
    WHEN 2 THEN minute(t) = 0 WHEN 3 THEN minute(t) % 15 = 0
    WHEN 4 THEN hour(t) = 6 AND minute(t) = 0 AND isodow(t) <= 5
    WHEN 5 THEN day(t) = 1 AND hour(t) = 0 AND minute(t) = 0
    WHEN 6 THEN hour(t) = 3 AND minute(t) = 15 AND (day(t) IN (1, 15) OR isodow(t) = 1) END"""


def _series(name: str, start: str, end: str) -> str:
    return f"""{name} AS (SELECT k.kind, t FROM
        (SELECT unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 MINUTE)) AS t) m,
        (SELECT unnest(range(0, 7)) AS kind) k WHERE {FITS})"""


TICKS = _series("series", FROM, UNTIL) + f""",
    ticks AS (SELECT d.id AS deployment_id, d.dag_id, s.t AS logical_date, s.kind
              FROM {{fx_deployments}} d JOIN series s ON s.kind = d.{KIND})"""


def _ticks(h, keep=()):
    return schedule.cron_ticks(h.fx_deployments, moment(FROM), moment(UNTIL), keep)


@check("sc1_parse_cron", """
    WITH every AS (SELECT array_to_string(range(0, 60), ',') AS minute, array_to_string(range(0, 24), ',') AS hour,
        array_to_string(range(1, 32), ',') AS mday, array_to_string(range(1, 13), ',') AS month, '0,1,2,3,4,5,6' AS wday)
    SELECT id, CASE dep_no % 8 WHEN 1 THEN '30' WHEN 3 THEN '0,15,30,45' WHEN 6 THEN '15' WHEN 7 THEN NULL ELSE '0' END AS minutes,
        CASE dep_no % 8 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 4 THEN '6' WHEN 5 THEN '0' WHEN 6 THEN '3' WHEN 7 THEN NULL ELSE hour END AS hours,
        CASE dep_no % 8 WHEN 5 THEN '1' WHEN 6 THEN '1,15' WHEN 7 THEN NULL ELSE mday END AS days,
        CASE dep_no % 8 WHEN 7 THEN NULL ELSE month END AS months,
        CASE dep_no % 8 WHEN 4 THEN '1,2,3,4,5' WHEN 6 THEN '1' WHEN 7 THEN NULL ELSE wday END AS weekdays,
        CASE dep_no % 8 WHEN 7 THEN NULL ELSE 'ok' END AS cron_status
    FROM {fx_deployments}, every""")
def _(h):
    parsed = schedule.parse_cron(h.fx_deployments)
    parts = ("minutes", "hours", "days", "months", "weekdays")
    return parsed.select(
        "id", "cron_status",
        *[F.array_join(F.col(f"cron_{p}").cast("array<string>"), ",").alias(p) for p in parts],
    )


@check("sc2_cron_ticks", f"WITH {TICKS} SELECT deployment_id, logical_date FROM ticks")
def _(h):
    return _ticks(h)


MISSED = f"""SELECT d.id AS deployment_id, d.dag_id, d.start_date AS logical_date FROM {{fx_deployments}} d
        WHERE catch_up AND enabled AND last_scheduled_at IS NULL AND {KIND} <> 7 AND start_date < TIMESTAMP '@UNTIL'
    UNION ALL SELECT d.id, d.dag_id, s.t FROM {{fx_deployments}} d JOIN caught s ON s.kind = d.{KIND}
        WHERE catch_up AND enabled AND last_scheduled_at IS NULL AND s.t > d.start_date
          AND (d.end_date IS NULL OR s.t <= d.end_date) AND s.t < TIMESTAMP '@UNTIL'"""


@check("sc3_catch_up_ticks", f"""
    WITH {_series("caught", FROM, UNTIL)} {MISSED.replace("@UNTIL", UNTIL)}""")
def _(h):
    return schedule.catch_up_ticks(h.fx_deployments, moment(UNTIL), ("dag_id",))


# The calendar's crons spelled out over days, and the seconds of a day they fire at.
BEGIN, FINISH = "2024-01-01 00:00:00", "2024-03-31 23:59:59"
FAR = "2033-01-01 00:00:00"
CALENDAR = """
    shifted AS (SELECT DATE '1999-01-01' + CAST(n AS INTEGER) AS d FROM (SELECT unnest(range(0, 13000)) AS n)),
    dated AS (SELECT d, day(d) AS dom, isodow(d) AS dow, last_day(d) AS last,
        date_trunc('month', d)::DATE AS first, make_date(year(d), month(d), 15) AS mid FROM shifted),
    worked AS (SELECT *, last - CASE isodow(last) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS last_work,
        first + CASE isodow(first) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS first_work,
        mid + CASE isodow(mid) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END AS mid_work FROM dated),
    days AS (SELECT d, kind FROM worked, (SELECT unnest(range(0, 13)) AS kind) WHERE CASE kind
        WHEN 0 THEN true WHEN 1 THEN d = last WHEN 2 THEN dow = 5 AND dom BETWEEN 15 AND 21
        WHEN 3 THEN dow = 5 AND d > last - 7 WHEN 4 THEN d = mid_work WHEN 5 THEN d = last_work WHEN 6 THEN d = first_work
        WHEN 7 THEN (dow = 1 AND dom <= 7) OR (dow = 3 AND dom BETWEEN 8 AND 14) WHEN 8 THEN dow = 1 WHEN 9 THEN dow = 7
        WHEN 10 THEN d = last OR (dow = 5 AND dom BETWEEN 8 AND 14) WHEN 11 THEN dom = 31 WHEN 12 THEN month(d) = 2 AND dom = 29 END),
    clock AS (SELECT kind, unnest(CASE kind WHEN 2 THEN [23400] WHEN 3 THEN [43200] WHEN 4 THEN [32400] WHEN 5 THEN [32400]
        WHEN 7 THEN [29700] WHEN 8 THEN [21610, 21640, 22810, 22840, 24010, 24040] WHEN 11 THEN [86340] ELSE [0] END) AS s
        FROM (SELECT unnest(range(0, 13)) AS kind)),
    calendar AS (SELECT kind, d::TIMESTAMP + to_seconds(s) AS t FROM days JOIN clock USING (kind))"""
UNSOUND = "CASE kind WHEN 15 THEN 'invalid' ELSE 'unsupported' END"


@check("sc1_calendar_crons", f"""
    SELECT kind, cron, count(*) AS deployments, CASE WHEN kind < 13 THEN 'ok' ELSE {UNSOUND} END AS cron_status,
           CASE kind WHEN 8 THEN '10,40' ELSE '0' END AS seconds, kind IN (1, 10) AS last_day,
           CASE kind WHEN 4 THEN '15' WHEN 5 THEN '32' WHEN 6 THEN '1' ELSE '' END AS workdays,
           CASE kind WHEN 2 THEN '53' WHEN 3 THEN '50' WHEN 7 THEN '11,32' WHEN 10 THEN '52' WHEN 14 THEN '53' ELSE '' END AS nth_weekdays
    FROM {{fx_calendar}} WHERE kind NOT IN (13, 15) GROUP BY kind, cron
    UNION ALL SELECT kind, cron, count(*), {UNSOUND}, '0', false, '', '' FROM {{fx_calendar}} WHERE kind IN (13, 15) GROUP BY kind, cron""")
def _(h):
    texts = h.fx_calendar.groupBy("kind", "cron").agg(F.count(F.lit(1)).alias("deployments"))
    return schedule.parse_cron(texts).select(
        "kind", "cron", "deployments", "cron_status", F.col("cron_last_day").alias("last_day"),
        *[F.array_join(F.col(f"cron_{p}").cast("array<string>"), ",").alias(p) for p in ("seconds", "workdays", "nth_weekdays")],
    )


@check("sc2_calendar_ticks", f"""
    WITH {CALENDAR}
    SELECT id AS deployment_id, t AS logical_date, 'ok' AS cron_status FROM {{fx_calendar}} JOIN calendar USING (kind)
    WHERE t BETWEEN TIMESTAMP '{BEGIN}' AND TIMESTAMP '{FINISH}'
    UNION ALL SELECT id, NULL, {UNSOUND} FROM {{fx_calendar}} WHERE kind >= 13""")
def _(h):
    ticks = schedule.cron_ticks(h.fx_calendar, moment(BEGIN), moment(FINISH)).withColumn("cron_status", F.lit("ok"))
    return ticks.unionByName(schedule.unscheduled(h.fx_calendar).drop("cron"), allowMissingColumns=True)


@check("sc3_calendar_catch_up", f"""
    WITH {CALENDAR}, c AS (SELECT * FROM {{fx_calendar}} WHERE enabled AND catch_up AND last_scheduled_at IS NULL AND kind < 13)
    SELECT id AS deployment_id, start_date AS logical_date FROM c
    UNION ALL SELECT id, t FROM c JOIN calendar USING (kind) WHERE t > start_date AND t < TIMESTAMP '{FINISH}'""")
def _(h):
    return schedule.catch_up_ticks(h.fx_calendar, moment(FINISH))


FRIDAY, SATURDAY = "2024-01-19 00:00:00", "2024-01-20 00:00:00"


@check("sc4_calendar_day", f"""
    WITH {CALENDAR}, live AS (SELECT *, catch_up AND last_scheduled_at IS NULL AS catching FROM {{fx_calendar}} WHERE enabled),
    fire AS (SELECT id, dag_id, t FROM live JOIN calendar USING (kind) WHERE NOT catching AND t >= TIMESTAMP '{FRIDAY}'
               AND t < TIMESTAMP '{SATURDAY}' AND (last_scheduled_at IS NULL OR t > last_scheduled_at)
             UNION ALL SELECT id, dag_id, start_date FROM live WHERE catching AND kind < 13
             UNION ALL SELECT id, dag_id, t FROM live JOIN calendar USING (kind) WHERE catching AND t > start_date AND t < TIMESTAMP '{SATURDAY}'),
    won AS (SELECT *, row_number() OVER (PARTITION BY dag_id, t ORDER BY id) = 1 AS created FROM fire),
    act AS (SELECT deployment_id AS id, count(*) AS n FROM {{fx_runs}} WHERE state = 'running' GROUP BY ALL),
    placed AS (SELECT w.*, row_number() OVER (PARTITION BY w.id ORDER BY t) AS pos, max_active_runs - coalesce(n, 0) AS budget
               FROM won w JOIN live USING (id) LEFT JOIN act USING (id) WHERE created),
    named AS (SELECT id, dag_id, t, CASE WHEN budget IS NULL OR pos <= budget THEN 'fired' ELSE 'deferred' END AS verdict FROM placed
              UNION ALL SELECT id, dag_id, t, 'already_created' FROM won WHERE NOT created)
    SELECT id AS deployment_id, dag_id, t AS logical_date,
           'scheduled-' || dag_id || '-' || strftime(t, '%Y%m%dT%H%M%S') AS run_id, verdict FROM named
    UNION ALL SELECT id, dag_id, NULL, NULL, {UNSOUND} || '_cron' FROM live WHERE kind >= 13""")
def _(h):
    return day.schedule_day(h.fx_calendar, moment(FRIDAY), moment(SATURDAY), aggregates.active_counts(h.fx_runs))


@check("jn12_previous_ticks", f"""
    WITH {CALENDAR}, asked AS (SELECT id, kind, TIMESTAMP '{BEGIN}' + to_hours(CAST(dep_no % 2000 AS INTEGER)) AS asked_at FROM {{fx_calendar}}),
    sought AS (SELECT a.kind, a.asked_at, (SELECT max(t) FROM calendar c WHERE c.kind = a.kind AND t < a.asked_at) AS tick
               FROM (SELECT DISTINCT kind, asked_at FROM asked) a)
    SELECT id AS deployment_id, asked_at, tick FROM asked JOIN sought USING (kind, asked_at)""")
def _(h):
    at = F.timestamp_add("HOUR", (F.col("dep_no") % 2000).cast("int"), moment(BEGIN))
    asked = h.fx_calendar.select(F.col("id").alias("deployment_id"), "cron", at.alias("asked_at"))
    return schedule.neighbour_ticks(asked, F.col("asked_at"), False, "tick").drop("cron")


@check("wn9_next_ticks", f"""
    WITH {CALENDAR}, asked AS (SELECT id, kind, TIMESTAMP '{BEGIN}' + to_hours(CAST(dep_no % 2000 AS INTEGER)) AS asked_at FROM {{fx_calendar}}),
    sought AS (SELECT a.kind, a.asked_at, (SELECT min(t) FROM calendar c WHERE c.kind = a.kind AND t > a.asked_at) AS tick
               FROM (SELECT DISTINCT kind, asked_at FROM asked) a)
    SELECT id AS deployment_id, asked_at AS logical_date, asked_at AS data_interval_start, tick AS data_interval_end FROM asked JOIN sought USING (kind, asked_at)""")
def _(h):
    at = F.timestamp_add("HOUR", (F.col("dep_no") % 2000).cast("int"), moment(BEGIN))
    asked = h.fx_calendar.select(F.col("id").alias("deployment_id"), "cron", at.alias("logical_date"))
    return windows.data_intervals(asked).drop("cron")


DAY, NEXT_DAY = "2024-01-04 00:00:00", "2024-01-05 00:00:00"


@check("sc4_schedule_day", f"""
    WITH {_series("caught", FROM, NEXT_DAY)},
    fire AS (SELECT d.id AS deployment_id, d.dag_id, s.t AS logical_date
             FROM {{fx_deployments}} d JOIN caught s ON s.kind = d.{KIND}
             WHERE enabled AND NOT (catch_up AND last_scheduled_at IS NULL)
               AND s.t >= TIMESTAMP '{DAY}' AND s.t < TIMESTAMP '{NEXT_DAY}' AND s.t >= start_date
               AND (end_date IS NULL OR s.t <= end_date) AND (last_scheduled_at IS NULL OR s.t > last_scheduled_at)
             UNION ALL {MISSED.replace("@UNTIL", NEXT_DAY)}),
    there AS (SELECT DISTINCT dag_id, TIMESTAMP '{DAY}' + to_hours(CAST(run_no % 24 AS INTEGER)) AS logical_date
              FROM {{fx_runs}} WHERE run_no % 3 = 0),
    open AS (SELECT * FROM fire f WHERE NOT EXISTS
             (SELECT 1 FROM there t WHERE t.dag_id = f.dag_id AND t.logical_date = f.logical_date)),
    won AS (SELECT *, row_number() OVER (PARTITION BY dag_id, logical_date ORDER BY deployment_id) = 1 AS created FROM open
            UNION ALL SELECT *, false FROM fire f WHERE EXISTS
             (SELECT 1 FROM there t WHERE t.dag_id = f.dag_id AND t.logical_date = f.logical_date)),
    act AS (SELECT deployment_id, count(*) AS n FROM {{fx_runs}} WHERE state = 'running' GROUP BY ALL),
    placed AS (SELECT w.*, row_number() OVER (PARTITION BY w.deployment_id ORDER BY logical_date) AS pos,
                      d.max_active_runs - coalesce(a.n, 0) AS budget
               FROM won w JOIN {{fx_deployments}} d ON d.id = w.deployment_id
               LEFT JOIN act a ON a.deployment_id = w.deployment_id WHERE created)
    SELECT deployment_id, dag_id, logical_date, 'scheduled-' || dag_id || '-' || strftime(logical_date, '%Y%m%dT%H%M%S') AS run_id,
           CASE WHEN budget IS NULL OR pos <= budget THEN 'fired' ELSE 'deferred' END AS verdict FROM placed
    UNION ALL SELECT deployment_id, dag_id, logical_date, 'scheduled-' || dag_id || '-' || strftime(logical_date, '%Y%m%dT%H%M%S'),
           'already_created' FROM won WHERE NOT created""")
def _(h):
    active = aggregates.active_counts(h.fx_runs)
    there = h.fx_runs.filter("run_no % 3 = 0").select(
        "dag_id", F.timestamp_add("HOUR", (F.col("run_no") % 24).cast("int"), moment(DAY)).alias("logical_date")
    )
    return day.schedule_day(h.fx_deployments, moment(DAY), moment(NEXT_DAY), active, there)


@check("jn11_plan_backfill", f"""
    WITH {TICKS}, one AS (SELECT DISTINCT dag_id, logical_date FROM ticks),
    known AS (SELECT DISTINCT dag_id FROM {{fx_runs}} WHERE run_no % 4 = 1)
    SELECT o.dag_id, o.logical_date, 'backfill-' || o.dag_id || '-' || strftime(o.logical_date, '%Y%m%dT%H%M%S') AS run_id,
           CASE WHEN k.dag_id IS NOT NULL AND hour(o.logical_date) < 12 THEN 'reset' ELSE 'new' END AS action
    FROM one o LEFT JOIN known k ON k.dag_id = o.dag_id""")
def _(h):
    from runlens.functions.states import make_run_id

    ticks = _ticks(h, ("dag_id",)).select("dag_id", "logical_date").distinct()
    # Runs of the morning exist for DAGs that were backfilled before.
    before = h.fx_runs.filter("run_id LIKE 'backfill-%'").select("dag_id").distinct()
    runs = ticks.filter("hour(logical_date) < 12").join(before, "dag_id", "left_semi").select(
        "dag_id", make_run_id(F.lit("backfill"), F.col("dag_id"), F.col("logical_date")).alias("run_id")
    )
    return joins.plan_backfill(ticks, runs, reset=True)


@check("jn12_due_ticks", f"""
    WITH {TICKS}, latest AS (SELECT deployment_id, max(logical_date) AS due_at FROM ticks
                             WHERE logical_date < TIMESTAMP '{NOW}' GROUP BY ALL)
    SELECT d.id AS deployment_id, due_at FROM {{fx_deployments}} d JOIN latest l ON l.deployment_id = d.id
    WHERE enabled AND cron IS NOT NULL AND due_at >= start_date AND (end_date IS NULL OR due_at <= end_date)
      AND (last_scheduled_at IS NULL OR due_at > last_scheduled_at)""")
def _(h):
    return joins.due_now(h.fx_deployments, moment()).select("deployment_id", "due_at")


@check("wn7_admit_under_limit", f"""
    WITH {TICKS}, act AS (SELECT deployment_id, count(*) AS n FROM {{fx_runs}} WHERE state = 'running' GROUP BY ALL),
    placed AS (SELECT t.deployment_id, t.logical_date, row_number() OVER (PARTITION BY t.deployment_id ORDER BY logical_date) AS queue_position,
                      d.max_active_runs - coalesce(a.n, 0) AS budget
               FROM ticks t JOIN {{fx_deployments}} d ON d.id = t.deployment_id LEFT JOIN act a ON a.deployment_id = t.deployment_id)
    SELECT deployment_id, logical_date, queue_position, budget IS NULL OR queue_position <= budget AS admitted FROM placed""")
def _(h):
    active = aggregates.active_counts(h.fx_runs)
    return windows.admit_under_limit(_ticks(h), h.fx_deployments, active).select(
        "deployment_id", "logical_date", "queue_position", "admitted"
    )


@check("wn7_deferred_counts", f"""
    WITH {TICKS}, act AS (SELECT deployment_id, count(*) AS n FROM {{fx_runs}} WHERE state = 'running' GROUP BY ALL),
    c AS (SELECT deployment_id, count(*) AS n FROM ticks GROUP BY ALL),
    b AS (SELECT c.deployment_id, c.n, CASE WHEN d.max_active_runs IS NULL THEN c.n
            ELSE greatest(least(c.n, d.max_active_runs - coalesce(a.n, 0)), 0) END AS admitted
          FROM c JOIN {{fx_deployments}} d ON d.id = c.deployment_id LEFT JOIN act a ON a.deployment_id = c.deployment_id)
    SELECT deployment_id, CAST(admitted AS BIGINT) AS admitted, CAST(n - admitted AS BIGINT) AS deferred FROM b""")
def _(h):
    active = aggregates.active_counts(h.fx_runs)
    return windows.deferred_counts(windows.admit_under_limit(_ticks(h), h.fx_deployments, active))


@check("wn9_data_intervals", f"""
    WITH {TICKS}, {_series("beyond", "2024-01-06 12:08:00", "2024-02-02 00:00:00")}, manual AS (SELECT id AS deployment_id, start_date AS logical_date FROM {{fx_deployments}} WHERE cron IS NULL)
    SELECT deployment_id, logical_date, logical_date AS data_interval_start,
           coalesce(lead(logical_date) OVER (PARTITION BY deployment_id ORDER BY logical_date),
             (SELECT min(t) FROM beyond WHERE beyond.kind = ticks.kind)) AS data_interval_end FROM ticks
    UNION ALL SELECT deployment_id, logical_date, logical_date, logical_date FROM manual""")
def _(h):
    manual = h.fx_deployments.filter("cron IS NULL").select(
        F.col("id").alias("deployment_id"), "cron", F.col("start_date").alias("logical_date")
    )
    ticks = _ticks(h, ("cron",)).unionByName(manual)
    return windows.data_intervals(ticks).drop("cron")


# --- variables -------------------------------------------------------------------

RESOLVED = """SELECT d.dag_id, l.var_key, arg_max(l.var_value, l.depth) AS var_value, arg_max(l.scope, l.depth) AS origin
    FROM {fx_variable_dags} d JOIN {fx_variable_layers} l ON starts_with(d.folder || '/', l.scope || '/') GROUP BY ALL"""


def _resolved(h):
    return V.resolve_variables(h.fx_variable_layers, h.fx_variable_dags)


@check("vr1_resolve_variables", RESOLVED)
def _(h):
    return _resolved(h)


def _pack(value: str) -> str:
    return f"'{{{{' || string_agg('\"' || k || '\":\"' || {value} || '\"', ',' ORDER BY k) || '}}}}'"


@check("vr2_apply_overrides", f"""
    WITH r AS ({RESOLVED}),
    layers AS (SELECT dag_id, var_key AS k, var_value AS v, 0 AS rank FROM r
        UNION ALL SELECT dag_id, 'v1', 'dep', 1 FROM {{fx_variable_dags}}
        UNION ALL SELECT dag_id, 'extra', 'dep', 1 FROM {{fx_variable_dags}}
        UNION ALL SELECT dag_id, 'v1', 'trigger', 2 FROM {{fx_variable_dags}} WHERE CAST(substr(dag_id, 5) AS BIGINT) % 2 = 0),
    top AS (SELECT dag_id, k, arg_max(v, rank) AS v FROM layers GROUP BY ALL)
    SELECT dag_id, {_pack("v")} AS variables FROM top GROUP BY dag_id""")
def _(h):
    scoped = V.variable_maps(_resolved(h))
    over = F.create_map(F.lit("v1"), F.lit("dep"), F.lit("extra"), F.lit("dep"))
    fired = F.when(
        F.expr("CAST(substring(dag_id, 5) AS BIGINT) % 2 = 0"), F.create_map(F.lit("v1"), F.lit("trigger"))
    )
    merged = V.apply_overrides(F.col("variables"), over, fired)
    return scoped.select("dag_id", maps.sorted_json(merged).alias("variables"))


@check("vr3_lookup_path", """
    SELECT trigger_id, coalesce(json_extract_string(variables, '$.v0'), '<unresolved>: vars(''v0'')') AS plain,
        coalesce(json_extract_string(variables, '$.v1'), 'fallback') AS with_default,
        CASE WHEN trigger_id % 3 = 2 THEN '<unresolved>: vars(''db.host'')' ELSE 'h' || trigger_id END AS nested
    FROM {fx_triggers}""")
def _(h):
    null = F.lit(None).cast("string")
    nested = F.when(
        F.col("trigger_id") % 3 == 2, F.lit('{"db":{}}')
    ).otherwise(F.concat(F.lit('{"db":{"host":"h'), F.col("trigger_id"), F.lit('"}}')))
    return h.fx_triggers.select(
        "trigger_id", V.lookup_path(F.col("variables"), F.lit("v0"), null).alias("plain"),
        V.lookup_path(F.col("variables"), F.lit("v1"), F.lit("fallback")).alias("with_default"),
        V.lookup_path(nested, F.lit("db.host"), null).alias("nested"),
    )


@check("vr4_merge_default_inputs", """
    SELECT task_no, CASE WHEN task_no % 2 = 0 THEN '{{"engine":"own","target":"t' || task_no || '"}}'
                         ELSE '{{"engine":"default","target":"t' || task_no || '"}}' END AS inputs FROM {fx_inputs}""")
def _(h):
    target = F.concat(F.lit("t"), F.col("task_no"))
    own = F.when(
        F.col("task_no") % 2 == 0,
        F.create_map(F.lit("target"), target, F.lit("engine"), F.lit("own")),
    ).otherwise(F.create_map(F.lit("target"), target))
    defaults = F.create_map(F.lit("engine"), F.lit("default"), F.lit("target"), F.lit("none"))
    return h.fx_inputs.select(
        "task_no", maps.sorted_json(V.merge_default_inputs(defaults, own)).alias("inputs")
    )


@check("vr5_substitute", """
    WITH vals AS (SELECT 'v' || CAST(r_regionkey AS VARCHAR) AS k, r_name AS v FROM {region}),
    i AS (SELECT p_partkey AS task_no, p_name, p_size, 'v' || CAST(p_size % 6 AS VARCHAR) AS k FROM {part})
    SELECT i.task_no, coalesce(v.v, '<unresolved>: vars(''' || i.k || ''')') || '/' || p_name
        || CASE WHEN i.task_no % 2 = 0 THEN '/none' ELSE '' END
        || CASE WHEN i.task_no % 3 = 0 THEN '/<unresolved: secrets(''KEY_' || p_size || ''')>' ELSE '' END AS text,
        'string' AS value_type FROM i LEFT JOIN vals v ON v.k = i.k""")
def _(h):
    # One map of all known variables on every row; here the regions' names.
    pairs = F.struct(
        F.concat(F.lit("v"), F.col("r_regionkey")).alias("key"), F.to_json(F.struct("r_name")).alias("value")
    )
    known = h.region.agg(
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(pairs)),
            lambda e: F.struct(e["key"], F.regexp_extract(e["value"], r'^\{"r_name":(.*)\}$', 1)),
        )).alias("m")
    )
    empty = F.create_map().cast("map<string,string>")
    inputs = h.fx_inputs.withColumns({
        "variables": known.scalar(), "outputs": empty, "runtime": empty, "secrets": empty,
    })
    return V.substitute(inputs).select(
        "task_no", F.get_json_object(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "$.v").alias("text"),
        "value_type",
    )


@check("vr5_substitute_typed", """
    SELECT run_no, 'row_count' AS input_key, CAST(CAST(json_extract_string(outputs, '$.row_count') AS BIGINT) AS VARCHAR) AS value_json, 'integer' AS value_type, CAST(NULL AS VARCHAR) AS warning
    FROM {fx_task_states} WHERE task_id = 't3' AND outputs LIKE '{{"row%'
    UNION ALL SELECT run_no, 'row_count', '"{{{{ outputs.t3.row_count }}}}"', 'string', 'unresolved reference: outputs.t3.row_count'
    FROM {fx_task_states} WHERE task_id = 't3' AND outputs NOT LIKE '{{"row%'
    UNION ALL SELECT run_no, 'label', '"' || run_id || '-done"', 'string', NULL FROM {fx_task_states} WHERE task_id = 't3'""")
def _(h):
    t3 = h.fx_task_states.filter("task_id = 't3'")
    empty = F.create_map().cast("map<string,string>")
    shaped = t3.select(
        "run_no",
        F.create_map(F.lit("t3"), maps.json_object(F.col("outputs"))).alias("outputs"),
        F.create_map(F.lit("run_id"), F.concat(F.lit('"'), F.col("run_id"), F.lit('"'))).alias("runtime"),
        empty.alias("variables"), empty.alias("secrets"),
        F.explode(F.create_map(
            F.lit("row_count"), F.lit("{{ outputs.t3.row_count }}"),
            F.lit("label"), F.lit("{{ runtime.run_id }}-done"),
        )).alias("input_key", "template"),
    )
    return V.substitute(shaped).select("run_no", "input_key", "value_json", "value_type", "warning")


@check("vr6_runtime_columns", """
    SELECT run_id, dag_id, task_id, logical_date AS run_date, logical_date, logical_date AS data_interval_start,
           logical_date + INTERVAL 1 DAY AS data_interval_end, CAST(n AS BIGINT) AS attempt_number
    FROM (SELECT dag_id, run_id, run_no, task_id, count(*) AS n FROM {fx_task_events} GROUP BY ALL)
    JOIN (SELECT run_no, logical_date FROM {fx_runs}) USING (run_no)""")
def _(h):
    attempts = h.fx_task_events.groupBy("run_no", "task_id").agg(F.collect_list("seq1").alias("attempts"))
    shaped = attempts.join(h.fx_runs, "run_no").withColumns({
        "run_date": F.col("logical_date"), "data_interval_start": F.col("logical_date"),
        "data_interval_end": F.expr("logical_date + INTERVAL 1 DAY"),
    })
    return filters.runtime_columns(shaped).withColumn("attempt_number", F.col("attempt_number").cast("long"))


@check("jn15_deployment_diff", f"""
    WITH r AS ({RESOLVED.replace("{fx_variable_dags}", "(SELECT dag_id, folder FROM {fx_variable_dags})")}),
    v AS (SELECT d.id, r.var_key, CASE WHEN d.pinned AND r.var_key = 'v1' THEN 'own' ELSE r.var_value END AS var_value,
                 d.pinned AND r.var_key = 'v1' AS is_override
          FROM {{fx_deployments}} d JOIN r ON r.dag_id = d.dag_id
          UNION ALL SELECT d.id, 'v1', 'own', TRUE FROM {{fx_deployments}} d WHERE d.pinned
              AND NOT EXISTS (SELECT 1 FROM r WHERE r.dag_id = d.dag_id AND r.var_key = 'v1'))
    SELECT d.id, d.dag_version, c.version AS bundle_version,
           CASE WHEN d.dag_version IS NOT DISTINCT FROM c.version THEN 'up-to-date' ELSE 'stale' END AS status,
           v.var_key, v.var_value, v.is_override
    FROM {{fx_deployments}} d LEFT JOIN {{fx_catalog}} c ON c.dag_id = d.dag_id
    LEFT JOIN v ON v.id = d.id AND d.dag_version IS DISTINCT FROM c.version""")
def _(h):
    overrides = h.fx_deployments.filter("pinned").select(
        F.col("id").alias("deployment_id"), F.lit("v1").alias("var_key"), F.lit("own").alias("var_value")
    )
    variables = V.deployment_variables(h.fx_deployments, _resolved(h), overrides)
    return joins.deployment_diff(h.fx_deployments, h.fx_catalog, variables).drop("dag_id", "pinned")


# --- sources, sinks and streams in batch form ------------------------------------------


@check("io7_normalize_sql_export", """
    SELECT id, start_date, enabled, catch_up, last_scheduled_at, CASE WHEN dep_no % 2 = 0 THEN 'ann,bob' ELSE '' END AS owners,
           CASE WHEN pinned THEN '{{"v1":"own"}}' ELSE '{{}}' END AS variable_overrides, pinned FROM {fx_deployments}""")
def _(h):
    export = h.fx_deployments.selectExpr(
        "id", "CASE WHEN dep_no % 3 = 0 THEN replace(CAST(start_date AS STRING), ' ', 'T') ELSE CAST(start_date AS STRING) END AS start_date",
        "CAST(enabled AS INT) AS enabled", "CAST(catch_up AS INT) AS catch_up",
        "CASE WHEN last_scheduled_at IS NULL THEN '{}' ELSE concat('{\"last_scheduled_at\":\"', last_scheduled_at, '\"}') END AS _scheduler",
        "CASE WHEN dep_no % 2 = 0 THEN '[\"ann\",\"bob\"]' END AS owners",
        "CASE WHEN pinned THEN '{\"v1\":\"own\"}' END AS variable_overrides",
    )
    return records.normalize_sql_export(export, "deployments").withColumn(
        "owners", F.array_join("owners", ",")
    )


@check("io11_route_logs", """
    SELECT seq, CASE WHEN source = 'task' THEN dag_id || '/' || run_id || '/' || task_id || '/attempt_'
        || coalesce(attempt, 1) || '.jsonl' ELSE 'framework.jsonl' END AS route FROM {fx_logs}""")
def _(h):
    return sinks.route_logs(h.fx_logs).select("seq", "route")


@check("io12_alert_records", """
    SELECT 'failure' AS event, strftime(updated_at, '%Y%m%d_%H%M%S_%f') AS timestamp, dag_id, task_id, run_id, seq1
    FROM {fx_task_events} WHERE state = 'failed'""")
def _(h):
    failures = tables.lifecycle_events(h.fx_task_events).filter("event = 'failure'")
    return sinks.alert_records(failures, "updated_at").select(
        "event", "timestamp", "dag_id", "task_id", "run_id", "seq1"
    )


@check("io14_bundle_fingerprint", """
    SELECT bundle_no, substr(sha256(string_agg(rel || '|' || size_bytes || '|' || mtime_ns || chr(10), '' ORDER BY string_split(rel, '/'))), 1, 12) AS version
    FROM {fx_manifest} WHERE rel NOT LIKE '%/.hidden' GROUP BY ALL""")
def _(h):
    return documents.bundle_fingerprint(h.fx_manifest, "bundle_no")


@check("ss1_zombie_silences", """
    WITH n AS (SELECT task_key, beat_at AS last_beat, kind, lead(beat_at) OVER (PARTITION BY task_key ORDER BY beat_at, seq) AS next_beat
               FROM {fx_heartbeats})
    SELECT task_key, last_beat, next_beat FROM n WHERE kind <> 'terminal'
        AND epoch_us(coalesce(next_beat, TIMESTAMP '2030-01-01')) - epoch_us(last_beat) > 3600000000""")
def _(h):
    return zombies.silences(h.fx_heartbeats, 3600, moment("2030-01-01 00:00:00"))


@check("ss2_stream_state_table", """
    SELECT run_id, task_id, state FROM {fx_task_states}""")
def _(h):
    return windows.current_states(
        h.fx_task_events, ["updated_at", "seq1", "seq2", "seq3"], ["run_id", "task_id"]
    ).select("run_id", "task_id", "state")


@check("ss3_alerts", """
    WITH e AS (SELECT dag_id, run_id, task_id, seq1, CASE state WHEN 'running' THEN 'start' WHEN 'success' THEN 'success'
                 WHEN 'failed' THEN 'failure' WHEN 'up_for_retry' THEN 'retry' WHEN 'skipped' THEN 'skipped' END AS event
               FROM {fx_task_events}),
    hooks AS (SELECT dag_id, 't' || CAST(dag_no % 7 + 1 AS VARCHAR) AS task_id, h.event, 'json-file' AS hook
              FROM {fx_dags}, unnest(['failure', 'retry']) AS h(event))
    SELECT e.dag_id, e.run_id, e.task_id, e.seq1, e.event, hook FROM e JOIN hooks USING (dag_id, task_id, event)""")
def _(h):
    hooks = h.fx_dags.select(
        "dag_id", F.expr("concat('t', dag_no % 7 + 1)").alias("task_id"),
        F.explode(F.array(F.lit("failure"), F.lit("retry"))).alias("event"), F.lit("json-file").alias("hook"),
    )
    return tables.match_hooks(tables.lifecycle_events(h.fx_task_events), hooks).select(
        "dag_id", "run_id", "task_id", "seq1", "event", "hook"
    )


@check("ss3_run_alerts", """
    SELECT run_id, unnest(CASE state WHEN 'running' THEN ['start'] WHEN 'success' THEN ['success', 'finished']
                               ELSE ['failure', 'finished'] END) AS event FROM {fx_runs}""")
def _(h):
    return tables.run_lifecycle_events(h.fx_runs).select("run_id", "event")


@check("ss4_first_claims", """
    SELECT trigger_id, arg_min(instance_id, seq) AS instance_id FROM {fx_claims} GROUP BY trigger_id""")
def _(h):
    return windows.claim_triggers(h.fx_claims, ["seq"]).select(
        "trigger_id", F.col("claimed_by").alias("instance_id")
    )


@check("ss5_first_runs", """
    SELECT dag_id, logical_date, count(*) AS candidates, CASE WHEN logical_date IS NULL THEN count(*) ELSE 1 END AS created
    FROM {fx_candidates} GROUP BY dag_id, logical_date""")
def _(h):
    decided = windows.dedup_scheduled_runs(
        h.fx_candidates, ["created_at", "instance_no", "line_no", "part_no", "run_id"]
    )
    return decided.groupBy("dag_id", "logical_date").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("created").alias("created")
    )


@check("ss6_tagged_log_lines", """
    SELECT seq, CASE WHEN source = 'task' THEN 'task' ELSE 'framework' END AS source, dag_id,
           CASE WHEN source = 'task' THEN CAST(coalesce(attempt, 1) AS BIGINT) END AS attempt FROM {fx_logs}""")
def _(h):
    lines = sinks.log_folders(h.fx_logs.select(
        "seq", "level", "msg", "source", "dag_id", "run_id", "task_id", "attempt", "extra"
    ))
    return lines.select(
        F.get_json_object("value", "$.seq").cast("long").alias("seq"), "source", "dag_id",
        F.col("attempt").cast("long").alias("attempt"),
    )


@check("ss7_retries", """
    WITH t AS (SELECT task_no, retries, retry_delay, exponential_backoff, count(*) AS n,
                      arg_max(state, attempt_number) AS last FROM {fx_attempts} GROUP BY ALL)
    SELECT task_no AS run_id, n AS attempts_made, TIMESTAMP '2024-01-01' + to_minutes(CAST(n AS INTEGER))
           + to_seconds(CASE WHEN exponential_backoff THEN retry_delay * 2.0 ** (n - 1) ELSE retry_delay END) AS due_at
    FROM t WHERE last NOT IN ('success', 'skipped') AND n <= retries""")
def _(h):
    ended = F.timestamp_add("MINUTE", F.col("attempt_number"), moment("2024-01-01 00:00:00"))
    attempts = h.fx_attempts.groupBy("task_no", "retries", "retry_delay", "exponential_backoff").agg(
        F.array_sort(F.collect_list(F.struct("attempt_number", "state", ended.alias("ended_at")))).alias("attempts")
    ).withColumns({"run_id": F.col("task_no"), "dag_id": F.lit("d"), "task_id": F.lit("t")})
    return tables.stream_retries(attempts).select(
        "run_id", F.col("attempts_made").cast("long").alias("attempts_made"), "due_at"
    )


