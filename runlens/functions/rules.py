"""The ten trigger rules as column expressions over upstream counts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.values import TRIGGER_RULES


def _conditions(
    success: Column, failed: Column, skipped: Column, done: Column, total: Column
) -> dict[str, Column]:
    finished = done >= total
    no_failed = finished & (failed == 0)
    return {
        "all_success": finished & (success == total),
        "all_failed": finished & (failed == total),
        "all_done": finished,
        "all_skipped": finished & (skipped == total),
        "one_success": success >= 1,
        "one_failed": failed >= 1,
        "none_failed": no_failed,
        "none_skipped": finished & (skipped == 0),
        "none_failed_min_one_success": no_failed & (success >= 1),
        "none_failed_or_skipped": no_failed & (skipped == 0),
    }


def rule_columns(prefix: str = "n_") -> dict[str, Column]:
    """Every rule's outcome, from the count columns `<prefix>success` and so on."""
    total = F.col(f"{prefix}total")
    outcomes = _conditions(
        F.col(f"{prefix}success"), F.col(f"{prefix}failed"),
        F.col(f"{prefix}skipped"), F.col(f"{prefix}done"), total,
    )
    return {rule: (total == 0) | outcomes[rule] for rule in TRIGGER_RULES}


def rule_satisfied(rule: Column, prefix: str = "n_") -> Column:
    """Outcome of the rule named by `rule`; null for a name that is no rule."""
    chosen = None
    for name, outcome in rule_columns(prefix).items():
        chosen = (
            F.when(rule == name, outcome) if chosen is None
            else chosen.when(rule == name, outcome)
        )
    return chosen


def blocked_state(broken_upstreams: Column) -> Column:
    """State of a task whose rule can no longer be met."""
    return F.when(broken_upstreams > 0, "upstream_failed").otherwise("skipped")
