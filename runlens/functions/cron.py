"""Cron text of five or six fields as one SQL expression, and the search for ticks in it; no Python per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names a cron field may use.
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun",
               "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAY_NAMES = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")

# Field name, lowest value, highest value, value of the first name, names.
FIELDS = (
    ("minutes", 0, 59, 0, ()),
    ("hours", 0, 23, 0, ()),
    ("days", 1, 31, 0, ()),
    ("months", 1, 12, 1, MONTH_NAMES),
    ("weekdays", 0, 7, 0, WEEKDAY_NAMES),
    ("seconds", 0, 59, 0, ()),
)
# Names of whole schedules.
ALIASES = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
ITEM_PATTERN = "^([*]|[?]|[0-9a-z]+(-[0-9a-z]+)?)(/[0-9]+)?$"
# Rules of the calendar: last day, last workday and nearest workday; nth and last weekday.
_NAMED = "|".join(WEEKDAY_NAMES)
DAY_RULE = "^(l|lw|(0?[1-9]|[12][0-9]|3[01])w)$"
WEEKDAY_RULE = f"^(([0-7]|{_NAMED})#[1-5]|l([0-7]|{_NAMED})|([0-7]|{_NAMED})l)$"
#: Months ahead or back in which a day of February 29 surely lies (two leap years are eight years apart at most).
FAR_MONTHS = 97


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it in `body` as `name`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _number(text: str, first: int, names: tuple) -> str:
    parsed = f"try_cast({text} AS INT)"
    if not names:
        return parsed
    pairs = ", ".join(f"'{name}', {value}" for value, name in enumerate(names, first))
    return f"coalesce({parsed}, try_element_at(map({pairs}), {text}))"


def _ranges(text: str, low: int, high: int, first: int, names: tuple) -> str:
    """SQL for the field's items as array of (ok, low, high, step)."""
    head = _number("substring_index(p.base, '-', 1)", first, names)
    tail = _number("substring_index(p.base, '-', -1)", first, names)
    split = (
        "named_struct('base', substring_index(i, '/', 1), 'stepped', contains(i, '/'), 'step', "
        "if(contains(i, '/'), try_cast(substring_index(i, '/', -1) AS INT), 1))"
    )
    bounds = (
        f"named_struct('ok', i rlike '{ITEM_PATTERN}', "
        f"'a', CASE WHEN p.base IN ('*', '?') THEN {low} ELSE {head} END, "
        f"'b', CASE WHEN p.base IN ('*', '?') THEN {high} "
        f"WHEN p.stepped AND NOT contains(p.base, '-') THEN {high} ELSE {tail} END, "
        "'step', p.step)"
    )
    return f"transform(split({text}, ','), i -> {_let('p', split, bounds)})"


def _values(ranges: str, modulo: int | None) -> str:
    spread = (
        f"flatten(transform(filter({ranges}, r -> r.a <= r.b AND r.step >= 1), "
        "r -> sequence(r.a, r.b, r.step)))"
    )
    if modulo:
        spread = f"transform({spread}, v -> v % {modulo})"
    return f"array_sort(array_distinct({spread}))"


def _sound(ranges: str, low: int, high: int) -> str:
    return (
        f"forall({ranges}, r -> coalesce(r.ok AND r.a >= {low} AND r.b <= {high} "
        "AND r.a <= r.b AND r.step >= 1, false))"
    )


def _weekday_rules(text: str) -> str:
    """SQL for the field's nth and last weekdays, as weekday * 10 + n, where 0 stands for the last."""
    name = "regexp_replace(i, '#.$|^l|l$', '')"
    day = _number(name, 0, WEEKDAY_NAMES)
    nth = "if(contains(i, '#'), cast(right(i, 1) AS INT), 0)"
    return f"transform(filter(split({text}, ','), i -> i rlike '{WEEKDAY_RULE}'), i -> {day} % 7 * 10 + {nth})"


def _without(text: str, rule: str) -> str:
    return f"array_join(filter(split({text}, ','), i -> NOT i rlike '{rule}'), ',')"


def parse(column: str) -> Column:
    """Struct of the six value arrays, the calendar's rules, `day_or` and `status`, from cron text.

    A sixth field holds seconds; without it a tick is at second 0. `last_day` is true for
    `L`; `workdays` holds n for `nW`, the workday nearest to day n in its month, and 32 for
    `LW`, the last one; `nth_weekdays` holds weekday * 10 + n for `5#3`, and weekday * 10
    for `L5` (or `5L`), the last one of a month. `status` is ok, invalid or unsupported
    (seven fields, other @names, plain weekdays beside nth ones, other uses of L, W and #).
    `day_or` is true where day of month and day of week are both restricted: then
    either may match.
    """
    texts = [f"coalesce(get(s, {i}), '')" for i in range(len(FIELDS))]
    texts[5] = "coalesce(get(s, 5), '0')"
    days, weekdays = texts[2], texts[4]
    plain_texts = [*texts]
    plain_texts[2], plain_texts[4] = _without(days, DAY_RULE), _without(weekdays, WEEKDAY_RULE)
    ranges = ", ".join(
        f"'{name}', {_ranges(plain_texts[i], low, high, first, names)}"
        for i, (name, low, high, first, names) in enumerate(FIELDS)
    )
    rules = f"exists(split({days}, ','), i -> i rlike '{DAY_RULE}')", f"exists(split({weekdays}, ','), i -> i rlike '{WEEKDAY_RULE}')"
    only = {2: f"{rules[0]} AND {plain_texts[2]} = ''", 4: f"{rules[1]} AND {plain_texts[4]} = ''"}  # nothing but rules
    values = ", ".join(
        f"'{name}', {_values(f'f.{name}', 7 if name == 'weekdays' else None)}"
        for name, *_ in FIELDS
    )
    sound = " AND ".join(
        f"({only[i]} OR {_sound(f'f.{name}', low, high)})" if i in only else _sound(f"f.{name}", low, high)
        for i, (name, low, high, *_) in enumerate(FIELDS)
    )
    odd = (
        f"startswith(get(s, 0), '@') OR size(s) = 7 OR exists(s, i -> i rlike '^[hr]($|[(/])') "
        f"OR {plain_texts[2]} rlike '[lw#]' OR {plain_texts[4]} rlike '#|(^|[,0-9])l' "
        f"OR ({rules[1]} AND {plain_texts[4]} <> '')"
    )
    workdays = (
        f"transform(filter(split({days}, ','), i -> i rlike '{DAY_RULE}' AND i <> 'l'), "
        "i -> coalesce(try_cast(rtrim('w', i) AS INT), 32))"
    )
    fields = (
        f"named_struct({values}, 'last_day', array_contains(split({days}, ','), 'l'), "
        f"'workdays', {workdays}, 'nth_weekdays', array_sort({_weekday_rules(weekdays)}), "
        f"'day_or', {days} NOT IN ('*', '?') AND {weekdays} NOT IN ('*', '?'), "
        f"'status', CASE WHEN {odd} THEN 'unsupported' WHEN size(s) IN (5, 6) AND {sound} THEN 'ok' "
        "ELSE 'invalid' END)"
    )
    named = " ".join(f"WHEN '{name}' THEN '{plain}'" for name, plain in ALIASES.items())
    plain = f"CASE lower(trim({column})) {named} ELSE lower(trim({column})) END"
    parts = f"split({plain}, '[ \\t]+')"
    parsed = _let("s", parts, _let("f", f"named_struct({ranges})", fields))
    return F.expr(f"if({column} IS NULL, NULL, {parsed})")


def day_matches(day: Column, parsed: Column) -> Column:
    """Whether a date is one of the cron's, months included."""
    number, weekday = F.dayofmonth(day), F.dayofweek(day) - 1
    last = F.dayofmonth(F.last_day(day))
    friday, monday = weekday == 5, weekday == 1

    def nearest(n: Column) -> Column:
        """The day is the workday nearest to day n of its month: n itself, the Friday before or the Monday after a
        weekend, unless that lies in another month; then the workday on the other side."""
        asked = F.when(n == 32, last).otherwise(n)
        return weekday.between(1, 5) & (
            (number == asked)
            | (friday & (number == asked - 1)) | (monday & (number == asked + 1) & (n != 32))
            | (friday & (number == asked - 2) & (asked == last)) | (monday & (number == 3) & (asked == 1))
        ) & (asked <= last)

    def nth(rule: Column) -> Column:
        n = rule % 10
        return (F.floor(rule / 10) == weekday) & F.when(n == 0, number > last - 7).otherwise(n == F.ceil(number / 7))

    in_days = F.array_contains(parsed["days"], number) | (parsed["last_day"] & (number == last)) | F.exists(parsed["workdays"], nearest)
    in_week = F.array_contains(parsed["weekdays"], weekday) | F.exists(parsed["nth_weekdays"], nth)
    return F.array_contains(parsed["months"], F.month(day)) & F.when(
        parsed["day_or"], in_days | in_week
    ).otherwise(in_days & in_week)


def _beyond(values: Column, edge: Column, ahead: bool) -> Column:
    """The value next to `edge` in a sorted array, above or below it; null if there is none."""
    if ahead:
        return F.get(F.filter(values, lambda v: v > edge), F.lit(0))
    return F.try_element_at(F.filter(values, lambda v: v < edge), F.lit(-1))


def _edge(values: Column, ahead: bool) -> Column:
    return F.get(values, F.lit(0)) if ahead else F.try_element_at(values, F.lit(-1))


def _time_beyond(at: Column, parsed: Column, ahead: bool) -> Column:
    """The nearest time of day beyond that of `at`, in seconds; null if the day holds no more. From coarse to fine:
    the hour and the minute are kept as long as a finer field has a value left."""
    hour, minute, second = F.hour(at), F.minute(at), F.second(at).cast("int")
    hours, minutes, seconds = (parsed[n] for n in ("hours", "minutes", "seconds"))
    in_minute = F.when(
        F.array_contains(hours, hour) & F.array_contains(minutes, minute),
        hour * 3600 + minute * 60 + _beyond(seconds, second, ahead),
    )
    in_hour = F.when(
        F.array_contains(hours, hour), hour * 3600 + _beyond(minutes, minute, ahead) * 60 + _edge(seconds, ahead)
    )
    return F.coalesce(in_minute, in_hour, _beyond(hours, hour, ahead) * 3600 + first_time(parsed, ahead) % 3600)


def first_time(parsed: Column, ahead: bool = True) -> Column:
    """First (or last) time of a day, in seconds."""
    return (
        _edge(parsed["hours"], ahead) * 3600 + _edge(parsed["minutes"], ahead) * 60 + _edge(parsed["seconds"], ahead)
    )


def _day_in(first: Column, last: Column, parsed: Column, ahead: bool) -> Column:
    """The first (or last) matching date between two dates of one month."""
    days = F.filter(F.sequence(first, last), lambda day: day_matches(day, parsed))
    return F.when(first <= last, _edge(days, ahead))


def add_neighbour(df: DataFrame, at: str, parsed: str, ahead: bool, out: str) -> DataFrame:
    """Add the cron's first tick after the time `at`, or its last one before, both exclusive; null if the cron is not
    sound or has none.

    A search in the value arrays, from coarse to fine; no ticks are made. A day is sought
    in the rest of its month, then in the next month that the cron names, and only
    where that lacks the day (30th, 31st, February 29) in all named months of eight
    years. Each step is a column of its own, so that none is computed twice.
    """
    cron = F.col(parsed)
    sign = 1 if ahead else -1
    whole = F.date_trunc("second", at).cast("timestamp_ntz")
    # backwards, a fraction counts as the next second: before it lies the tick of its whole second
    moment = whole if ahead else F.when(whole < F.col(at), F.timestamp_add("SECOND", F.lit(1), whole)).otherwise(whole)
    month, start, end, day = F.month("__day"), F.col("__start"), F.col("__end"), F.col("__day")
    first, last = (F.date_add(day, 1), end) if ahead else (start, F.date_sub(day, 1))
    named = F.coalesce(_beyond(cron["months"], month, ahead), _edge(cron["months"], ahead) + 12 * sign) - month
    months = F.transform(F.sequence(F.lit(1), F.lit(FAR_MONTHS)), lambda n: F.add_months(start, n * sign))
    far = F.filter(
        F.transform(
            F.filter(months, lambda begin: F.array_contains(cron["months"], F.month(begin))),
            lambda begin: _day_in(begin, F.last_day(begin), cron, ahead),
        ),
        lambda found: found.isNotNull(),
    )
    here, near, time = F.col("__here"), F.col("__near"), F.col("__time")
    steps = (
        ("__moment", F.when(cron["status"] == "ok", moment)),
        ("__day", F.to_date("__moment")),
        ("__time", F.when(day_matches(day, cron), _time_beyond(F.col("__moment"), cron, ahead))),
        ("__start", F.trunc("__day", "month")), ("__end", F.last_day("__day")),
        ("__here", F.when(time.isNull(), _day_in(first, last, cron, ahead))),
        ("__begin", F.add_months(start, named)),
        ("__near", F.when(time.isNull() & here.isNull(), _day_in(F.col("__begin"), F.last_day("__begin"), cron, ahead))),
        ("__far", F.when(time.isNull() & here.isNull() & near.isNull(), F.get(far, F.lit(0)))),
        ("__found", F.when(time.isNotNull(), day).otherwise(F.coalesce("__here", "__near", "__far"))),
        (out, F.timestamp_add("SECOND", F.coalesce("__time", first_time(cron, ahead)), F.col("__found").cast("timestamp_ntz"))),
    )
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop(*[name for name, _ in steps[:-1]])
