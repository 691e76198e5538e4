"""Gates over call metrics: a cost ratio in a rolling window, flags among the last rows, an hours budget, and a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.text import col
from calltide.functions.values import budget_band, exact_average, exact_sum, in_window


@dataclass(frozen=True)
class Limits:
    """Window, thresholds and counts of the gates."""

    window_days: int = 7
    ratio_abort: float = 1.5
    ratio_warn: float = 1.35
    last_n: int = 5
    flags_least: int = 2
    hours_budget: float = 2.0
    hours_warn_share: float = 0.9


def window_cost(rows: DataFrame, now: Column, cost: str = "cost_usd", ts: str = "ts", days: int = 7) -> DataFrame:
    """One row: n rows in the window and avg_cost of their numeric costs (null of none)."""
    inside = rows.where(in_window(ts, now, days))
    return inside.agg(F.count(F.lit(1)).alias("n"), exact_average(cost).alias("avg_cost"))


def cost_ratio(wrapped: DataFrame, baseline: DataFrame, now: Column, limits: Limits = Limits(), cost: str = "cost_usd", ts: str = "ts") -> DataFrame:
    """One row: counts, averages, their ratio (null unless both are there and not zero) and its status."""
    w = window_cost(wrapped, now, cost, ts, limits.window_days).select(F.col("n").alias("wrapped_calls"), F.col("avg_cost").alias("wrapped_avg"))
    b = window_cost(baseline, now, cost, ts, limits.window_days).select(F.col("n").alias("baseline_calls"), F.col("avg_cost").alias("baseline_avg"))
    ratio = F.when((F.col("wrapped_avg") != 0) & (F.col("baseline_avg") > 0), F.col("wrapped_avg") / F.col("baseline_avg"))
    return w.crossJoin(F.broadcast(b)).withColumn("ratio", ratio).withColumn("ratio_status", budget_band(F.col("ratio"), limits.ratio_abort, limits.ratio_warn))


def last_flags(metrics: DataFrame, limits: Limits = Limits(), flag: str = "conclusion_changed", seq: str = "seq") -> DataFrame:
    """One row: how many of the last n rows by seq have the flag true, of how many, and the status."""
    last = metrics.select(seq, flag).orderBy(F.desc(seq)).limit(limits.last_n)
    one = last.agg(F.count(F.lit(1)).alias("last_rows"), F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("flagged"))
    return one.withColumn("flag_status", flag_status(limits))


def flag_status(limits: Limits = Limits()) -> Column:
    """unknown, abort, warn or ok, from last_rows and flagged."""
    few, many = F.col("flagged") < limits.flags_least, F.col("flagged") == limits.flags_least
    return F.when(F.col("last_rows") < limits.last_n, "unknown").when(few, "abort").when(many, "warn").otherwise("ok")


def hours_used(metrics: DataFrame, now: Column, limits: Limits = Limits(), hours: str = "maintenance_hours", ts: str = "ts") -> DataFrame:
    """One row: the hours noted in the window (null counts 0) and the status against the budget."""
    one = metrics.where(in_window(ts, now, limits.window_days)).agg(F.coalesce(exact_sum(hours), F.lit(0.0)).alias("hours"))
    return one.withColumn("hours_status", budget_band(F.col("hours"), limits.hours_budget, limits.hours_budget * limits.hours_warn_share))


def verdict(metrics: DataFrame, baseline: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """One row: the gates' figures and statuses, ``gates`` as an array, issues and warnings, verdict and exit code.

    Metrics need seq, ts, cost_usd, conclusion_changed and maintenance_hours, the baseline ts and cost_usd. Any abort
    makes ABORT (2); else any warning or unknown gate makes EXTEND (1); else CONTINUE (0).
    """
    return judge(cost_ratio(metrics, baseline, now, limits).crossJoin(F.broadcast(last_flags(metrics, limits))).crossJoin(F.broadcast(hours_used(metrics, now, limits))), limits)


def judge(one: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``one`` with gates, issues, warnings, verdict and exit code, row by row from ratio, flagged, hours and their statuses."""
    gate = lambda name, value, threshold, status: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), col(status).alias("status"))
    gates = F.array(
        gate("cost_ratio", F.col("ratio"), limits.ratio_abort, "ratio_status"), gate("conclusion_changed", F.col("flagged"), limits.flags_least, "flag_status"), gate("maintenance_hours", F.col("hours"), limits.hours_budget, "hours_status")
    )
    one = one.withColumn("gates", gates)
    named = lambda *statuses: F.transform(F.filter("gates", lambda g: g["status"].isin(*statuses)), lambda g: g["name"])
    one = one.withColumn("issues", named("abort")).withColumn("warnings", named("warn", "unknown"))
    word = F.when(F.size("issues") > 0, "ABORT").when(F.size("warnings") > 0, "EXTEND").otherwise("CONTINUE")
    return one.withColumn("verdict", word).withColumn("exit_code", F.when(F.size("issues") > 0, 2).when(F.size("warnings") > 0, 1).otherwise(0))


def history(metrics: DataFrame, baseline: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The verdict as it stood at each row of the metrics, one row each: seq, ts, the gates' figures and what ``judge`` adds.

    Windows end at the row's time, rows of that time included, and begin ``window_days`` before; flags are those of the last
    rows by seq up to it. A row of unknown time has unknown cost ratio and hours. seq tells the rows apart.
    """
    from calltide.operators.intime import DAY_US, last_n, rolling

    money = lambda c: F.col(c).cast("decimal(28,8)")
    count = lambda c: F.when(c, 1).cast("bigint")
    series = [
        (metrics, "ts", {"wrapped_calls": F.lit(1).cast("bigint"), "w_cost": money("cost_usd"), "w_costs": count(F.col("cost_usd").isNotNull()), "w_hours": money("maintenance_hours")}),
        (baseline, "ts", {"baseline_calls": F.lit(1).cast("bigint"), "b_cost": money("cost_usd"), "b_costs": count(F.col("cost_usd").isNotNull())}),
    ]
    sums = rolling(metrics.select("seq", "ts"), "seq", "ts", series, limits.window_days * DAY_US)
    average = lambda total, n: F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n))
    rated = sums.select("seq", "wrapped_calls", average("w_cost", "w_costs").alias("wrapped_avg"), "baseline_calls", average("b_cost", "b_costs").alias("baseline_avg"), F.col("w_hours").cast("double").alias("hours"))
    ratio = F.when((F.col("wrapped_avg") != 0) & (F.col("baseline_avg") > 0), F.col("wrapped_avg") / F.col("baseline_avg"))
    rated = rated.withColumn("ratio", ratio).withColumn("ratio_status", budget_band(F.col("ratio"), limits.ratio_abort, limits.ratio_warn))
    rated = rated.withColumn("hours_status", budget_band(F.col("hours"), limits.hours_budget, limits.hours_budget * limits.hours_warn_share))
    flags = last_n(metrics.select("seq", "ts", F.coalesce("conclusion_changed", F.lit(False)).alias("flag")), ["seq"], limits.last_n)
    flags = flags.select("seq", "ts", F.size("last").alias("last_rows"), F.size(F.filter("last", lambda r: r["flag"])).alias("flagged")).withColumn("flag_status", flag_status(limits))
    return judge(flags.join(rated, "seq"), limits)
