"""Variable scopes, overrides and template substitution."""

from conftest import rows
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import aggregates, joins
from runlens.operators import variables as V


def test_closest_scope_wins(spark):
    layers = spark.createDataFrame(
        [("dags", 1, False, "foo", "bundle"), ("dags", 1, False, "bar", "bundle"), ("dags", 1, False, "baz", "bundle"),
         ("dags/g", 2, False, "bar", "group"), ("dags/g", 2, False, "baz", "group"), ("dags/g/d", 3, True, "baz", "dag"),
         ("dags/other", 2, False, "foo", "other"), ("dags/g", 2, True, "foo", "not for d")],
        "scope string, depth int, is_dag_scope boolean, var_key string, var_value string",
    )
    dags = spark.createDataFrame([("d", "dags/g/d"), ("e", "dags/gg")], "dag_id string, folder string")
    assert rows(V.resolve_variables(layers, dags), "dag_id", "var_key", "var_value", "origin") == [
        ("d", "bar", "group", "dags/g"), ("d", "baz", "dag", "dags/g/d"), ("d", "foo", "bundle", "dags"),
        ("e", "bar", "bundle", "dags"), ("e", "baz", "bundle", "dags"), ("e", "foo", "bundle", "dags"),
    ]


def test_overrides_are_layered(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "1", "c": "1"}, {"b": "2", "c": "2"}, {"c": "3", "d": "3"}), ({"a": "1"}, None, None)],
        "s map<string,string>, d map<string,string>, t map<string,string>",
    )
    got = [r[0] for r in df.select(V.apply_overrides(F.col("s"), F.col("d"), F.col("t"))).collect()]
    assert got == [{"a": "1", "b": "2", "c": "3", "d": "3"}, {"a": "1"}]


LOOKUPS = [
    ("a", None, "1"), ("db.host", None, "h"), ("db.port", "5", "5"), ("zz", None, "<unresolved>: vars('zz')"),
    ("db.x.y", None, "<unresolved>: vars('db.x.y')"), ("zz", "d", "d"),
]


def test_lookup(spark):
    document = '{"a":1,"db":{"host":"h"}}'
    df = spark.createDataFrame([(document, k, d) for k, d, _ in LOOKUPS], "v string, k string, d string")
    got = [r[0] for r in df.select(V.lookup_path(F.col("v"), F.col("k"), F.col("d"))).collect()]
    assert got == [want for *_, want in LOOKUPS]


VARIABLES = {"s": '"bucket"', "n": "5", "l": "[1,2]", "b": "false", "o": '{"host":"h","port":1}', "nul": "null"}


TEMPLATES = [
    ("plain", '"plain"', "string", False),
    ('{{ vars("s") }}', '"bucket"', "string", False),
    ("{{vars('n')}}", "5", "integer", False),
    ('{{ vars("l") }}', "[1,2]", "array", False),
    ('{{ vars("b") }}', "false", "boolean", False),
    ('{{ vars("nul") }}', "null", "null", False),
    ('{{ vars("o.host") }}', '"h"', "string", False),
    ('{{ vars("o.port") }}', "1", "integer", False),
    ('x-{{ vars("n") }}-{{ vars("b") }}', '"x-5-False"', "string", False),
    ('{{ vars("n") }}{{ vars("n") }}', '"55"', "string", False),
    ('{{ vars("zz") }}', "\"<unresolved>: vars('zz')\"", "string", False),
    ('{{ vars("zz", "d") }}', '"d"', "string", False),
    ('{{ vars("zz", 7) }}', "7", "integer", False),
    ('{{ vars("zz", None) }}', "\"<unresolved>: vars('zz')\"", "string", False),
    ('{{ secrets("K") }}', '"s3cret"', "string", False),
    ('{{ secrets("Q") }}', "\"<unresolved: secrets('Q')>\"", "string", False),
    ("{{ outputs.t1.rows }}", "9", "integer", False),
    ("{{ outputs.t2.rows }}", '"{{ outputs.t2.rows }}"', "string", True),
    ("{{ runtime.run_id }}/a", '"r-1/a"', "string", False),
    ("{{ runtime.nope }}", '"{{ runtime.nope }}"', "string", True),
    ("{{ 1 + 1 }}", '"{{ 1 + 1 }}"', "string", True),
]


def test_substitution(spark):
    maps = (VARIABLES, {"t1": '{"rows":9}'}, {"run_id": '"r-1"'}, {"K": "s3cret"})
    df = spark.createDataFrame(
        [(case[0], *maps) for case in TEMPLATES],
        "template string, variables map<string,string>, outputs map<string,string>, runtime map<string,string>, secrets map<string,string>",
    )
    got = [
        (r["template"], r["value_json"], r["value_type"], r["warning"] is not None)
        for r in V.substitute(df).collect()
    ]
    assert got == TEMPLATES


def test_substituted_text_is_not_read_again(spark):
    df = spark.createDataFrame(
        [('a {{ vars("x") }} b', {"x": '"{{ vars(1) }}"'}, {}, {}, {})],
        "template string, variables map<string,string>, outputs map<string,string>, runtime map<string,string>, secrets map<string,string>",
    )
    assert V.substitute(df).first()["value_json"] == '"a {{ vars(1) }} b"'


def test_required_variables(spark):
    inputs = spark.createDataFrame(
        [(1, "{{ vars('a', 'x') }} {{ vars(\"a\") }}"), (2, "{{ vars('b', \"y\") }}"), (3, "{{ vars('b', None) }} {{ vars('db.host') }} {{ vars('db.nope') }}")],
        "pos int, template string",
    )
    provided = spark.createDataFrame([("a", "1"), ("db", '{"host":"h"}')], "var_key string, var_value string")
    got = aggregates.required_variables(inputs, provided, ["pos"])
    assert rows(got, "var_key", "has_default", "default_value", "found_in") == [
        ("a", False, None, "variables"), ("b", True, '"y"', None),
        ("db.host", False, None, "variables"), ("db.nope", False, None, None),
    ]


def test_text_helpers(spark):
    df = spark.createDataFrame([("getHTTPResponseCode",), ("HTTPResponseCodeXYZ",), ("camel2_camel2_case",)], "s string")
    assert [r[0] for r in df.select(text.snake_case(F.col("s"))).collect()] == [
        "get_http_response_code", "http_response_code_xyz", "camel2_camel2_case",
    ]
    df = spark.createDataFrame([(["a=1", " b =2=3", "a=9", "bad"],)], "items array<string>")
    row = df.select(text.parse_kv(F.col("items")), text.bad_kv(F.col("items"))).first()
    assert row[0] == {"b": "2=3", "a": "9"} and row[1] == ["bad"]


def test_triggers_need_their_variables(spark):
    triggers = spark.createDataFrame(
        [("t1", "d", '{"a":"1"}'), ("t2", "d", "{}"), ("t3", "gone", "{}"), ("t4", "full", "{}"), ("t5", "nodag", "{}")]
        + [(f"u{i}", "two", "{}" if i == 1 else '{"a":"1"}') for i in range(6)],
        "trigger_id string, deployment_id string, variables string",
    ).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    needs = spark.createDataFrame(
        [("d", "a", False, False), ("d", "b", False, True), ("d", "c", True, False), ("full", "a", False, False),
         ("two", "a", False, False)],
        "deployment_id string, var_key string, has_default boolean, overridden boolean",
    )
    deps = spark.createDataFrame(
        [("d", "g", None), ("full", "g", 1), ("nodag", "zz", 3), ("two", "g", 3)], "id string, dag_id string, max_active_runs int"
    )
    dags = spark.createDataFrame([("g",)], "dag_id string")
    active = spark.createDataFrame([("full", 1), ("two", 1)], "deployment_id string, active_runs long")
    got = joins.admit_triggers(triggers, deps, dags, active, needs)
    assert rows(got, "trigger_id", "verdict") == [
        ("t1", "admitted"), ("t2", "invalid_variables"), ("t3", "unknown_deployment"),
        ("t4", "max_active_runs"), ("t5", "unknown_dag"),
        # one run is active and the limit is three: two more, an unfit one takes no place
        ("u0", "admitted"), ("u1", "invalid_variables"), ("u2", "admitted"),
        ("u3", "max_active_runs"), ("u4", "max_active_runs"), ("u5", "max_active_runs"),
    ]
    assert joins.validate_triggers(triggers, needs).first()["error"] == "missing_variable"


def test_sync_classes(spark):
    deps = spark.createDataFrame(
        [("new", "g", None, False), ("old", "g", "v1", False), ("same", "g", "v2", False), ("pin-new", "g", None, True),
         ("pin-old", "g", "v1", True), ("pin-same", "g", "v2", True), ("lost", "zz", "v1", False)],
        "id string, dag_id string, dag_version string, pinned boolean",
    )
    bundle = spark.createDataFrame([("g", "v2")], "dag_id string, version string")
    assert rows(joins.roll_deployments(deps, bundle), "id", "verdict", "new_version") == [
        ("lost", "unknown", "v1"), ("new", "rolled", "v2"), ("old", "rolled", "v2"), ("pin-new", "rolled", "v2"),
        ("pin-old", "pinned_stale", "v1"), ("pin-same", "pinned_current", "v2"), ("same", "unchanged", "v2"),
    ]
