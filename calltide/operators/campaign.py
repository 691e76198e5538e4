"""Campaign state: defaults, current turn, running spend, units."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltide.functions.text import last_part, strings, title_from_slug


def with_defaults(campaigns: DataFrame, budget: float, model: str) -> DataFrame:
    """(slug, name, started, spend, spend_budget, model): a missing name is made of the slug, missing figures are the defaults."""
    name = F.coalesce(F.nullif("name", F.lit("")), title_from_slug("slug"))
    return campaigns.select(
        "slug", name.alias("name"), F.coalesce("started", F.lit("")).alias("started"), F.coalesce("spend", F.lit(0.0)).cast("double").alias("spend"),
        F.coalesce("spend_budget", F.lit(budget)).cast("double").alias("spend_budget"), F.coalesce("model", F.lit(model)).alias("model"),
    )


def current_turn(turns: DataFrame, key: str = "slug") -> DataFrame:
    """(key, turn): the largest turn number; a null one counts 0."""
    return turns.groupBy(key).agg(F.coalesce(F.max(F.coalesce("turn", F.lit(0))), F.lit(0)).alias("turn"))


def summary(campaigns: DataFrame, turns: DataFrame, budget: float, model: str) -> DataFrame:
    """Campaigns with defaults and their current turn, 0 before the first."""
    return with_defaults(campaigns, budget, model).join(current_turn(turns), "slug", "left").na.fill(0, ["turn"])


def with_current(turns: DataFrame, key: str = "slug", turn: str = "turn") -> DataFrame:
    """``current``: whether a turn is the newest of its campaign."""
    newest = F.max(turn).over(Window.partitionBy(key))
    return turns.withColumn("current", F.coalesce(F.col(turn) == newest, F.lit(False)))


def issue_turn(turns: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """The log with new entries (turn given or one more than the newest), the model's short name, and current set anew."""
    known = current_turn(turns, key).withColumnRenamed("turn", "__turn")
    entries = new.join(known, key, "left").withColumn("turn", F.coalesce(F.col("turn"), F.coalesce("__turn", F.lit(0)) + 1)).withColumn("model", last_part("model")).drop("__turn")
    return with_current(turns.drop("current").unionByName(entries.drop("current"), allowMissingColumns=True), key)


def add_spend(campaigns: DataFrame, calls: DataFrame, key: str = "slug", cost: str = "cost_usd") -> DataFrame:
    """Spend plus the costs of new calls (null counts 0), rounded to six places at each call.

    Spend has six places once it is written, so rounding after each addition is rounding each cost: a sum in any order.
    """
    new = calls.groupBy(key).agg(F.sum(F.round(F.coalesce(F.col(cost), F.lit(0.0)).cast("decimal(28,8)"), 6)).alias("__new"))
    joined = campaigns.join(new, key, "left")
    return joined.withColumn("spend", F.round(F.coalesce("spend", F.lit(0.0)) + F.coalesce("__new", F.lit(0)).cast("double"), 6)).drop("__new")


def health(spark: SparkSession, checks: Mapping[str, bool | str], campaigns_: DataFrame) -> DataFrame:
    """One row: ok, checks as a map, ``issues`` (checks that are false or begin with "missing", in their order) and how many campaigns there are."""
    bad = [k for k, v in checks.items() if v is False or (isinstance(v, str) and v.startswith("missing"))]
    shown = F.create_map(*(F.lit(x) for k, v in checks.items() for x in (k, str(v).lower() if isinstance(v, bool) else v))) if checks else F.create_map().cast("map<string,string>")
    return campaigns_.agg(F.count(F.lit(1)).alias("campaigns")).select(F.lit(not bad).alias("ok"), shown.alias("checks"), strings(bad).alias("issues"), "campaigns")


def health_of(checks: DataFrame, key: str = "project") -> DataFrame:
    """(key, ok, checks map, issues) of a table of checks (key, place, name, value): one row per project, which has a few checks.

    A check fails where its value is "false" or begins with "missing"; issues are in the order of ``place``.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", "name", "value")))
    bad = F.filter("__rows", lambda r: (r["value"] == "false") | r["value"].startswith("missing"))
    held = checks.groupBy(key).agg(rows.alias("__rows"))
    return held.select(key, (F.size(bad) == 0).alias("ok"), F.map_from_entries(F.transform("__rows", lambda r: F.struct(r["name"], r["value"]))).alias("checks"), F.transform(bad, lambda r: r["name"]).alias("issues"))


def units(tasks: DataFrame) -> DataFrame:
    """One row per unit of both sides of tasks (blue, red arrays of structs), in their order."""
    side = lambda s: tasks.select(F.lit(s).alias("side"), F.posexplode(s).alias("place", "u")).select("side", "place", "u.*")
    return side("blue").unionByName(side("red"))
