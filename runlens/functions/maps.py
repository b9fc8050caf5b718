"""Map and JSON-object helpers that need no session setting."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_wins(entries: Column) -> Column:
    """Array of (key, value) structs to a map; a repeated key keeps its last value."""

    def is_last(entry: Column, index: Column) -> Column:
        later = F.slice(entries, index + 2, F.size(entries))
        return ~F.exists(later, lambda other: other["key"] == entry["key"])

    return F.map_from_entries(F.filter(entries, is_last))


def merged(base: Column, over: Column) -> Column:
    """Shallow merge of two maps; keys of `over` win."""
    kept = F.map_filter(base, lambda key, _: ~F.array_contains(F.map_keys(over), key))
    return F.map_concat(kept, over)


def sorted_json(column: Column) -> Column:
    """JSON text of a map with its keys in order."""
    entries = F.array_sort(F.map_entries(column))
    return F.to_json(F.map_from_entries(entries))


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else `{}`."""
    return F.when(F.trim(text).startswith("{"), text).otherwise("{}")


def json_to_map(text: Column) -> Column:
    """Top-level members of a JSON object as map of text; bad text gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def json_at(text: Column, path: Column) -> Column:
    """`get_json_object` with a path that is a column."""
    return F.call_function("get_json_object", text, path)
