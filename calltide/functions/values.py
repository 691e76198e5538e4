"""Column functions on times, costs and lists, with the null rules of the call logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calltide.functions.text import col


def first_truthy(*columns: Column | str, default: object = None) -> Column:
    """The first that is neither null nor zero, else ``default``."""
    zero = [F.when(col(c) != 0, col(c)) for c in columns]
    return F.coalesce(*zero, *([F.lit(default)] if default is not None else []))


def parse_timestamp(text: Column | str) -> Column:
    """Strict yyyy-MM-ddTHH:mm:ss with Z, +HHMM or +HH:MM; anything else, fractions too, is null."""
    t = col(text)
    shaped = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$")
    return F.when(shaped, F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXX")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))


def age_days(now: Column, then: Column | str) -> Column:
    """Days between two timestamps, with fraction."""
    return F.timestamp_diff("MICROSECOND", col(then), now) / F.lit(86_400_000_000.0)


def recency(age: Column | str, decay_days: float = 30.0) -> Column:
    """1 falling in a line to 0 at ``decay_days``; more than 1 for the future, 0 for an unknown age."""
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - col(age) / F.lit(decay_days)), F.lit(0.0))


def in_window(then: Column | str, now: Column, days: int = 7) -> Column:
    """At or after now - days; unknown times are outside, future ones inside."""
    return F.coalesce(col(then) >= now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def age_bucket(then: Column | str, today: Column) -> Column:
    """today, 1 day ago, N days ago, N mo ago."""
    days = F.date_diff(today, col(then))
    months = F.floor(days / 30).cast("string")
    return F.when(days <= 0, "today").when(days == 1, "1 day ago").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(months, F.lit(" mo ago")))


def age_label(text: Column | str, today: Column) -> Column:
    """age_bucket of a date written as text; blank stays blank, and what is no date is given back."""
    t = F.coalesce(col(text), F.lit(""))
    return F.when(t == "", "").otherwise(F.coalesce(age_bucket(F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.to_date(parse_timestamp(t))), today), t))


def elapsed_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds between two timestamps, cut towards zero."""
    return (F.timestamp_diff("MICROSECOND", col(start), col(end)) / 1000).cast("bigint")


def response_cost(cost: Column | str, total_cost: Column | str) -> Column:
    """The response's cost unless it is null or zero, else the usage's total cost."""
    return F.coalesce(F.nullif(col(cost), F.lit(0.0)), col(total_cost))


def rounded(value: Column | str, places: int = 3) -> Column:
    """For display; results that are computed with stay unrounded."""
    return F.round(col(value), places)


def newest_first(items: Column | str, most: int) -> Column:
    """The last ``most`` items of an array, last first; null has none."""
    return F.coalesce(F.slice(F.reverse(col(items)), 1, most), F.array())


def int_ids(ids: Column | str) -> Column:
    """Distinct ints of a list of strings, sorted; what is no int is left out, and null gives none."""
    each = F.transform(F.coalesce(col(ids).cast("array<string>"), F.array().cast("array<string>")), lambda x: F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x)).try_cast("int"))
    return F.sort_array(F.array_distinct(F.filter(each, lambda x: x.isNotNull())))


def shared_ids(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_intersect(col(a), col(b)))


def exact_sum(value: Column | str) -> Column:
    """A sum that does not depend on the order of rows: over DECIMAL(28,8), as double."""
    return F.sum(col(value).cast("decimal(28,8)")).cast("double")


def exact_average(value: Column | str) -> Column:
    """An average that does not depend on the order of rows; null of no values."""
    return exact_sum(value) / F.count(col(value))


def budget_band(value: Column, abort_above: float, warn_above: float) -> Column:
    """abort, warn, ok, or unknown for null; both bounds are exclusive."""
    return F.when(value.isNull(), "unknown").when(value > abort_above, "abort").when(value > warn_above, "warn").otherwise("ok")


def vram_delta(before: Column | str, after: Column | str) -> Column:
    """after - before; null where either is null or zero."""
    a, b = col(after), col(before)
    return F.when((a != 0) & (b != 0), a - b)


def training_minutes(rows: Column, epochs: int, batch: int, accumulate: int, backend: str) -> Column:
    """Whole minutes that a run of (rows * epochs) // (batch * accumulate) steps takes."""
    seconds = {"unsloth": 4.0, "mlx": 8.0, "kaggle": 6.0}.get(backend, 5.0)
    return F.floor(F.floor(rows * epochs / (batch * accumulate)) * seconds / 60).cast("long")


def plan_estimate(rows: Column, per_row_cost: float, per_row_seconds: float, workers: int) -> Column:
    """struct(calls, cost_usd, minutes) of a generation plan."""
    return F.struct(rows.cast("long").alias("calls"), (rows * per_row_cost).alias("cost_usd"), (rows * per_row_seconds / workers / 60).alias("minutes"))


def ui_estimate(chars: Column | str) -> Column:
    """struct(tokens, cost_usd) that the order form shows before a call: a fixed preamble and a fixed answer length."""
    tokens = F.round(F.lit(4180.0) + col(chars) / 4).cast("long")
    return F.struct(tokens.alias("tokens"), (tokens / 1000 * 6.5e-3 + F.lit(612 / 1000 * 22.5e-3)).alias("cost_usd"))
