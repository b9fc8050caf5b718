"""Fixed values of the workflow-run data model (states, rules, transitions)."""

# Task states.
TASK_STATES = (
    "none", "scheduled", "queued", "running", "up_for_retry",
    "success", "failed", "skipped", "upstream_failed", "removed",
)
# Task states that are final.
TERMINAL_STATES = ("success", "failed", "skipped", "upstream_failed", "removed")

# Outcome of one attempt.
ATTEMPT_STATES = ("running", "success", "failed", "skipped", "timed_out")

# Trigger rules.
TRIGGER_RULES = (
    "all_success", "all_failed", "all_done", "all_skipped", "one_success",
    "one_failed", "none_failed", "none_skipped",
    "none_failed_min_one_success", "none_failed_or_skipped",
)

# Legal state changes (from, to).
LEGAL_TRANSITIONS = (
    ("none", "scheduled"), ("none", "skipped"), ("none", "upstream_failed"),
    ("scheduled", "queued"),
    ("queued", "running"),
    ("running", "success"), ("running", "failed"), ("running", "skipped"),
    ("running", "up_for_retry"),
    ("up_for_retry", "queued"), ("up_for_retry", "failed"),
)
# The worker moves tasks straight from none to queued; the strict table does
# not allow that step, the observed table does.
OBSERVED_TRANSITIONS = LEGAL_TRANSITIONS + (("none", "queued"),)

# Run-id prefixes that name the trigger of a run.
RUN_TRIGGERS = ("manual", "backfill", "scheduled")

# States a user may force a task into.
MARK_STATES = ("failed", "success", "skipped")

# Lifecycle events hooks can subscribe to.
TASK_EVENTS = ("start", "success", "failure", "retry", "skipped")
DAG_EVENTS = ("start", "success", "failure", "finished")

# Standard log-record attributes that never go into `extra`.
STANDARD_LOG_ATTRIBUTES = (
    "name", "msg", "args", "levelname", "levelno", "pathname", "filename",
    "module", "exc_info", "exc_text", "stack_info", "lineno", "funcName",
    "created", "msecs", "relativeCreated", "thread", "threadName",
    "processName", "process", "message", "asctime", "taskName",
)

# Seconds of silence after which a running task is a zombie.
ZOMBIE_THRESHOLD_SECONDS = 300

# File names that hold variables, not DAG documents.
DAG_VARIABLES_FILE = "variables.yml"
GLOBAL_VARIABLES_FILE = "global_variables.yml"
