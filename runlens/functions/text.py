"""Column expressions over identifiers, templates and references."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.maps import last_wins

# Patterns of the text forms that records may hold.
TEMPLATE_PATTERN = r"(?s)\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}"
REMOTE_REF_PATTERN = (
    r"^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?"
    r"(/[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?)?"
    r"@[a-zA-Z0-9][a-zA-Z0-9._+\-]*$"
)
VARS_PATTERN = r"""vars\s*\(\s*["']([^"']+)["'](?:\s*,\s*([^)]+))?\s*\)"""
SECRETS_PATTERN = r"""secrets\s*\(\s*["']([^"']+)["']\s*\)"""


def snake_case(text: Column) -> Column:
    words = F.regexp_replace(text, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1_$2"))


def has_template(text: Column) -> Column:
    return text.rlike(TEMPLATE_PATTERN)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_kv(items: Column) -> Column:
    """`k=v` texts to a map: key trimmed, value kept as it is, last one wins."""
    pairs = F.filter(items, lambda item: item.contains("="))
    entries = F.transform(
        pairs,
        lambda item: F.struct(
            strip(F.substring_index(item, "=", 1)).alias("key"),
            F.substring(item, F.instr(item, "=") + 1, F.length(item)).alias("value"),
        ),
    )
    return last_wins(entries)


def bad_kv(items: Column) -> Column:
    """The items of `items` that are no `k=v` text."""
    return F.filter(items, lambda item: ~item.contains("="))


def plugin_ref(uses: Column) -> Column:
    """Struct (kind, name, version, install_spec) of a task's `uses`."""
    remote = uses.rlike(REMOTE_REF_PATTERN)
    name = F.regexp_extract(uses, r"^(.*)@", 1)
    version = F.substring_index(uses, "@", -1)
    in_repository = name.contains("/")
    return F.struct(
        F.when(~remote, "local").when(in_repository, "repository")
        .otherwise("package").alias("kind"),
        F.when(remote, name).otherwise(uses).alias("name"),
        F.when(remote, version).alias("version"),
        F.when(
            remote & in_repository,
            F.concat(F.lit("git+https://github.com/"), name, F.lit("@"), version),
        ).when(remote, F.concat(name, F.lit("=="), version)).alias("install_spec"),
    )
