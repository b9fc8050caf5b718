"""Scoped variables and template substitution as joins and column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.maps import json_at, merged

UNRESOLVED = "<unresolved>"


def ancestors(folder: Column) -> Column:
    """`a/b/c` to [`a`, `a/b`, `a/b/c`]."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda depth: F.array_join(F.slice(parts, 1, depth), "/"),
    )


def resolve_variables(layers: DataFrame, dags: DataFrame) -> DataFrame:
    """Value of every variable each DAG sees, and the scope it comes from.

    `layers` has (scope, depth, var_key, var_value) and may have
    `is_dag_scope`, true for variables of one DAG's own folder. `dags` has
    (dag_id, folder). Each DAG joins the layers of its own ancestor folders
    by equality; the closest scope wins per key.
    """
    own = F.col("is_dag_scope") if "is_dag_scope" in layers.columns else F.lit(False)
    scoped = layers.select("scope", "depth", "var_key", "var_value", own.alias("is_dag_scope"))
    chain = dags.select("dag_id", "folder", F.explode(ancestors(F.col("folder"))).alias("scope"))
    visible = chain.join(scoped, "scope").filter(
        ~F.col("is_dag_scope") | (F.col("scope") == F.col("folder"))
    )
    closest = F.max_by(
        F.struct("var_value", F.col("scope").alias("origin")),
        F.struct("depth", "is_dag_scope"),
    )
    return visible.groupBy("dag_id", "var_key").agg(closest.alias("__v")).select(
        "dag_id", "var_key", "__v.var_value", "__v.origin"
    )


def variable_maps(resolved: DataFrame) -> DataFrame:
    """Per DAG the map key -> value; its size is the number of variables in scope."""
    entries = F.array_sort(F.collect_list(F.struct("var_key", "var_value")))
    return resolved.groupBy("dag_id").agg(F.map_from_entries(entries).alias("variables"))


def apply_overrides(scoped: Column, deployment: Column, trigger: Column) -> Column:
    """Deployment overrides over scoped variables, trigger overrides over both."""
    empty = F.create_map().cast("map<string,string>")
    base = merged(F.coalesce(scoped, empty), F.coalesce(deployment, empty))
    return merged(base, F.coalesce(trigger, empty))


def deployment_variables(
    deployments: DataFrame, resolved: DataFrame, overrides: DataFrame
) -> DataFrame:
    """(deployment_id, var_key, var_value, origin): scoped variables under overrides.

    `overrides` has (deployment_id, var_key, var_value).
    """
    scoped = deployments.select(F.col("id").alias("deployment_id"), "dag_id").join(
        resolved, "dag_id"
    ).select("deployment_id", "var_key", "var_value", "origin", F.lit(0).alias("rank"))
    over = overrides.select(
        "deployment_id", "var_key", "var_value", F.lit("deployment").alias("origin"),
        F.lit(1).alias("rank"),
    )
    top = F.max_by(F.struct("var_value", "origin"), "rank")
    return scoped.unionByName(over).groupBy("deployment_id", "var_key").agg(
        top.alias("__v")
    ).select("deployment_id", "var_key", "__v.var_value", "__v.origin")


def lookup_path(variables_json: Column, key: Column, default: Column) -> Column:
    """Dotted lookup in a JSON object; default, then an `<unresolved>` text."""
    path = F.concat(
        F.lit("$"),
        F.array_join(F.transform(F.split(key, r"\."), lambda part: F.concat(F.lit("['"), part, F.lit("']"))), ""),
    )
    sentinel = F.concat(F.lit(f"{UNRESOLVED}: vars('"), key, F.lit("')"))
    return F.coalesce(json_at(variables_json, path), default, sentinel)


def merge_default_inputs(defaults: Column, inputs: Column) -> Column:
    """DAG default inputs under the task's own inputs."""
    empty = F.create_map().cast("map<string,string>")
    return merged(F.coalesce(defaults, empty), F.coalesce(inputs, empty))


_REFERENCE = r"\{\{\s*(.*?)\s*\}\}"
_VARS = r"""^vars\s*\(\s*["']([^"']+)["']\s*(?:,\s*(.+?)\s*)?\)$"""
_SECRET = r"""^secrets\s*\(\s*["']([^"']+)["']\s*\)$"""
_OUTPUT = r"^outputs\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_.]+)$"
_RUNTIME = r"^runtime\.([A-Za-z_]+)$"


def references(template: Column) -> Column:
    """The references of a template, in order."""
    return F.regexp_extract_all(template, F.lit(_REFERENCE), 1)


def is_known_reference(reference: Column) -> Column:
    """Whether a reference is of a kind that can be resolved at run time."""
    return reference.rlike(_VARS) | reference.rlike(_SECRET) | reference.rlike(_OUTPUT) | reference.rlike(_RUNTIME)


def _json_text(text: Column) -> Column:
    """Any text as JSON string literal; null stays null."""
    literal = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(text.isNotNull(), literal)


def _literal(text: Column) -> Column:
    """A literal default of a template call as JSON; `None` counts as no default."""
    quoted = F.regexp_extract(text, r"""(?s)^["'](.*)["']$""", 1)
    return (
        F.when(text.isin("", "None"), F.lit(None))
        .when(text == "True", "true")
        .when(text == "False", "false")
        .when(text.rlike(r"""^["']"""), _json_text(quoted))
        .otherwise(text)
    )


def _dotted(document: Column, path: Column) -> Column:
    """JSON value below a JSON document, null where the path leads nowhere."""
    wrapped = F.concat(F.lit('{"v":'), document, F.lit("}"))
    text = json_at(wrapped, F.concat(F.lit("$.v."), path))
    kind = F.schema_of_variant(F.try_parse_json(text))
    plain = kind.isNull() | (kind == "STRING")
    return F.when(text.isNull(), F.lit(None)).when(plain, _json_text(text)).otherwise(text)


def _reference_value(
    reference: Column, variables: Column, outputs: Column, runtime: Column, secrets: Column
) -> Column:
    """JSON value of one reference, null if it cannot be resolved."""
    key = F.regexp_extract(reference, _VARS, 1)
    head = F.substring_index(key, ".", 1)
    direct = F.try_element_at(variables, head)
    nested = _dotted(direct, F.regexp_replace(key, r"^[^.]*\.", ""))
    found = F.when(key.contains("."), nested).otherwise(direct)
    default = _literal(F.regexp_extract(reference, _VARS, 2))
    missing = F.concat(F.lit(f"\"{UNRESOLVED}: vars('"), key, F.lit("')\""))
    secret = F.regexp_extract(reference, _SECRET, 1)
    no_secret = F.concat(F.lit("\"<unresolved: secrets('"), secret, F.lit("')>\""))
    task, member = (F.regexp_extract(reference, _OUTPUT, n) for n in (1, 2))
    return (
        F.when(reference.rlike(_VARS), F.coalesce(found, default, missing))
        .when(
            reference.rlike(_SECRET),
            F.coalesce(_json_text(F.try_element_at(secrets, secret)), no_secret),
        )
        .when(reference.rlike(_OUTPUT), _dotted(F.try_element_at(outputs, task), member))
        .when(
            reference.rlike(_RUNTIME),
            F.try_element_at(runtime, F.regexp_extract(reference, _RUNTIME, 1)),
        )
    )


def _as_text(value: Column) -> Column:
    """How a JSON value reads inside a longer text."""
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return (
        F.when(value == "true", "True").when(value == "false", "False")
        .when(value == "null", "None").otherwise(quoted)
    )


def _value_type(value: Column) -> Column:
    return (
        F.when(value.startswith('"'), "string")
        .when(value.isin("true", "false"), "boolean")
        .when(value == "null", "null")
        .when(value.startswith("["), "array")
        .when(value.startswith("{"), "object")
        .when(value.rlike(r"^-?[0-9]+$"), "integer")
        .otherwise("number")
    )


def substitute(inputs: DataFrame) -> DataFrame:
    """Replace the references of every input.

    Needs `template` and the maps `variables`, `outputs`, `runtime`, `secrets`
    (text to JSON text; secrets to plain text). A template that is a single
    reference keeps its value's type; mixed text becomes a string. A template
    with an unknown reference stays as it is and gets a `warning`.
    The maps ride on the row, so there is no join per reference.
    """
    references = F.regexp_extract_all("template", F.lit(_REFERENCE), 1)
    values = F.transform(
        "__refs",
        lambda ref: _reference_value(
            ref, F.col("variables"), F.col("outputs"), F.col("runtime"), F.col("secrets")
        ),
    )
    parts = F.split("template", r"\{\{.*?\}\}", -1)
    text = F.array_join(
        F.transform(
            parts,
            lambda part, at: F.concat(
                part,
                F.coalesce(_as_text(F.try_element_at("__values", at + 1)), F.lit("")),
            ),
        ),
        "",
    )
    pure = (F.size("__refs") == 1) & F.col("template").rlike(r"^\{\{.*?\}\}$")
    first_unknown = F.try_element_at(
        F.filter(
            F.arrays_zip(F.col("__refs").alias("r"), F.col("__values").alias("v")),
            lambda pair: pair["v"].isNull(),
        ),
        F.lit(1),
    )["r"]
    resolved = (
        inputs.withColumn("__refs", references)
        .withColumn("__values", values)
        .withColumn("__unknown", first_unknown)
    )
    value = (
        F.when(F.col("__unknown").isNotNull(), _json_text(F.col("template")))
        .when(pure, F.try_element_at("__values", F.lit(1)))
        .otherwise(_json_text(text))
    )
    return resolved.withColumn("value_json", value).withColumns({
        "value_type": _value_type(F.col("value_json")),
        "warning": F.when(
            F.col("__unknown").isNotNull(),
            F.concat(F.lit("unresolved reference: "), F.col("__unknown")),
        ),
    }).drop("__refs", "__values", "__unknown")
