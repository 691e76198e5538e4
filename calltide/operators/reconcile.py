"""Differences of two states of a log as bags of rows, as a feed of keyed changes, and the feed applied again.

Rows are compared whole, nulls equal nulls, and copies count: a row that one state has twice more is two changes. Everything
is counted by whole rows, which combine before they are shuffled; no key's rows are gathered, so a key may hold most of them.
Columns have to be ones that Spark can group by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of one row that one task writes.
COPIES_AT_ONCE = 10_000


def _counted(*parts: tuple[DataFrame, object]) -> DataFrame:
    """(the first part's columns, copies): the signed number of copies of each row over all parts, where it isn't 0."""
    columns, out = [c for c in parts[0][0].columns], None
    for rows, copies in parts:
        one = rows.select(*(F.col(f"`{c}`") for c in columns), (copies if not isinstance(copies, int) else F.lit(copies)).cast("bigint").alias("__copies"))
        out = one if out is None else out.unionByName(one)
    counted = out.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.sum("__copies").alias("__copies"))
    return counted.where("__copies <> 0")


def bag_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(columns of ``old``, __copies): rows of which ``new`` has more copies (positive) or fewer (negative)."""
    return _counted((old, -1), (new, 1))


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(op, key, before, after, copies): what makes ``new`` of ``old``.

    A key of which one row goes and one comes is an update with both; all else are deletes (before) and inserts (after), a
    row for each different one with its number of copies. Missing keys are one key.
    """
    columns = old.columns
    diff = bag_difference(old, new).select(F.struct(F.col(f"`{key}`").alias("k")).alias("k"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("__copies").alias("copies"))
    going, coming = F.col("copies") < 0, F.col("copies") > 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.abs("copies"))), F.lit(0))
    one = lambda c: F.first(F.when(c, F.col("row")), ignorenulls=True)
    per_key = diff.groupBy("k").agg(total(going).alias("gone"), total(coming).alias("came"), one(going).alias("before"), one(coming).alias("after"))
    moved = per_key.where("gone = 1 AND came = 1")
    updates = moved.select(F.lit("update").alias("op"), F.col("k.k").alias("key"), "before", "after", F.lit(1).cast("bigint").alias("copies"))
    rest = diff.join(moved.select("k"), "k", "left_anti")
    others = rest.select(F.when(going, "delete").otherwise("insert").alias("op"), F.col("k.k").alias("key"), F.when(going, F.col("row")).alias("before"), F.when(coming, F.col("row")).alias("after"), F.abs("copies").alias("copies"))
    return updates.unionByName(others)


def apply_feed(old: DataFrame, feed: DataFrame) -> DataFrame:
    """``old`` with the feed's changes; copies of a row are told apart by number only. Deleting what is not there leaves nothing of it.

    Rows that no change names are passed on as they are; the others are counted anew and written out in pieces of bounded size.
    """
    columns = old.columns
    minus = feed.where("before IS NOT NULL").select("before.*", (-F.col("copies")).alias("__n"))
    plus = feed.where("after IS NOT NULL").select("after.*", F.col("copies").alias("__n"))
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    changes = minus.unionByName(plus).select(row.alias("__row"), "__n").groupBy("__row").agg(F.sum("__n").alias("__n"))
    held = old.select(row.alias("__row"))
    named = held.join(changes.select("__row"), "__row", "left_semi").groupBy("__row").agg(F.count(F.lit(1)).alias("__n"))
    left = named.unionByName(changes).groupBy("__row").agg(F.sum("__n").alias("__n")).where("__n > 0")
    pieces = left.select("__row", "__n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / COPIES_AT_ONCE) - 1)).alias("__p")).repartition(F.col("__row"), F.col("__p"))
    size = F.least(F.col("__n") - F.col("__p") * COPIES_AT_ONCE, F.lit(COPIES_AT_ONCE))
    again = pieces.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), size)).alias("__k")).select("__row.*")
    return held.join(changes.select("__row"), "__row", "left_anti").select("__row.*").unionByName(again)
