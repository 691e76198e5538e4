"""Windows and joins over time without one task for all of it: everything is dealt to stretches of time, which carry over little.

``rolling`` takes range frames as differences of running sums: within a stretch by a window, before it by the stretches' sums.
``last_n`` takes row frames over a global order: chunks of it, each with the last rows of the chunks before. ``asof_join`` and
``interval_join`` deal both sides to (key, stretch), so a key with a third of all rows is as many tasks as it has stretches.
A stretch is as wide as ``width_us`` says; a stretch, not a key, has to fit a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.text import col
from calltide.sources.scratch import written

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
_BEFORE_ALL = -(1 << 62)


def micros(time: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp of either kind, as the clock shows it; null of null."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), col(time).cast("timestamp_ntz"))


def rolling(points: DataFrame, point_id: str, time: str, series: Sequence[tuple[DataFrame, str, dict[str, Column]]], back_us: int, width_us: int = HOUR_US) -> DataFrame:
    """(point_id, sums): for each point the sums over each series' rows with times in [time - back_us, time], both inclusive.

    ``series`` are (rows, their time, name -> summand); summands are longs or decimals, so that differences are exact, and a
    null adds nothing. ``point_id`` tells points apart. A sum without rows is 0. Points of unknown time have null sums; rows of
    unknown time are in no frame. One row for each stretch with rows passes through one task, which adds them up.
    """
    names = [n for _, _, values in series for n in values]
    parts, own = [], points.select(F.col(point_id).alias("id"), micros(time).alias("us"))
    for rows, at, values in series:
        # rows lie on odd places, so that a probe can stand just before or after all rows of a moment
        parts.append(rows.select(F.lit(None).cast(own.schema["id"].dataType).alias("id"), (micros(at) * 2 + 1).alias("o"), F.lit(0).alias("sign"), *((values[n] if n in values else F.lit(None)).alias(n) for n in names)))
    kinds = {n: next(p.schema[n].dataType for p, (_, _, values) in zip(parts, series, strict=True) if n in values) for n in names}
    probe = lambda o, sign: own.select("id", o.alias("o"), F.lit(sign).alias("sign"), *(F.lit(None).alias(n) for n in names))
    parts += [probe(F.col("us") * 2 + 2, 1), probe((F.col("us") - back_us) * 2, -1)]
    all_ = None
    for p in parts:
        typed = p.where("o IS NOT NULL").select("id", "o", "sign", *(F.col(n).cast(kinds[n]).alias(n) for n in names))
        all_ = typed if all_ is None else all_.unionByName(typed)
    all_ = all_.withColumn("stretch", F.floor(F.col("o") / (2 * width_us)))
    # before a stretch: the sums of all earlier ones, one row each
    totals = all_.groupBy("stretch").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("stretch", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}__before") for n in names))
    within = Window.partitionBy("stretch").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    run = all_.select("stretch", "id", "sign", *(F.coalesce(F.sum(n).over(within), F.lit(0)).alias(n) for n in names)).where("sign <> 0")
    signed = run.join(before, "stretch").select("id", *((F.col("sign") * (F.col(n) + F.col(f"{n}__before"))).alias(n) for n in names))
    sums = signed.groupBy("id").agg(*(F.sum(n).alias(n) for n in names))
    return points.select(F.col(point_id)).join(sums.withColumnRenamed("id", point_id), point_id, "left")


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "idx", chunk_rows: int = 100_000) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in the order of ``order`` over all rows, without one task for them all.

    Rows are dealt to chunks by ranges of the order and written so; each is numbered by itself, from the sum of those before
    it (one row a chunk). Rows that tie in ``order`` are numbered in any order.
    """
    chunks = max(1, -(-rows.count() // chunk_rows))
    exprs = [F.asc(o) if isinstance(o, str) else o for o in order]
    dealt = written(rows.repartitionByRange(chunks, *exprs).withColumn("__chunk", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__chunk", F.coalesce(F.sum("__n").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__chunk").orderBy(*exprs)) - 1
    return dealt.withColumn(name, within).join(F.broadcast(before), "__chunk").withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop("__chunk", "__before")


def last_n(rows: DataFrame, order: Sequence[str], n: int, chunk_rows: int = 100_000) -> DataFrame:
    """Every row with ``last``, an array of the structs of the ``n`` rows that end with it in the order of ``order``, oldest first.

    Rows are dealt to chunks by ranges of the order and written so; each chunk gets the last n - 1 rows before it, which are
    found among the last rows of all chunks (n - 1 for each of them). Rows that tie in ``order`` come in any order.
    """
    chunks = max(1, -(-rows.count() // chunk_rows))
    dealt = written(rows.select(F.struct(*rows.columns).alias("r"), F.struct(*order).alias("o")).repartitionByRange(chunks, "o").withColumn("chunk", F.spark_partition_id()), "chunks")
    back = Window.partitionBy("chunk").orderBy(F.desc("o"))
    tails = dealt.withColumn("k", F.row_number().over(back)).where(F.col("k") < n)
    # at most n - 1 rows for each chunk are numbered in one task; a chunk's first number tells which come before it
    numbered = written(tails.withColumn("g", F.row_number().over(Window.orderBy("chunk", F.desc("k")))).drop("k"), "tails")
    starts = numbered.groupBy("chunk").agg(F.min("g").alias("start"))
    needed = numbered.drop("chunk").withColumn("start", F.explode(F.sequence(F.col("g") + 1, F.col("g") + n - 1))) if n > 1 else numbered.drop("chunk").withColumn("start", F.lit(-1)).where("false")
    carried = needed.join(F.broadcast(starts), "start").select("r", "o", "chunk", F.lit(False).alias("own"))
    frame = Window.partitionBy("chunk").orderBy("o").rowsBetween(1 - n, 0)
    whole = dealt.select("r", "o", "chunk", F.lit(True).alias("own")).unionByName(carried)
    return whole.withColumn("last", F.collect_list("r").over(frame)).where("own").select("r.*", "last")


def asof_join(left: DataFrame, right: DataFrame, time: str = "ts", by: Sequence[str] = (), ties: str = "seq", tolerance_us: int | None = None, name: str = "m", width_us: int = HOUR_US) -> DataFrame:
    """Every row of ``left`` once, with struct ``name``: the last row of ``right`` with its key at or before its time, else null.

    Both sides have the columns ``by`` and ``time``; missing keys match missing keys. Of right rows at one time the one of
    largest ``ties`` is last. With ``tolerance_us`` an older one does not count. Rows of unknown time match nothing.
    A stretch hands on its last right row only: one row for each (key, stretch) passes through the key's window.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    key = lambda df: [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    stretch = F.floor(F.col("__us") / width_us).alias("__stretch")
    inner = lambda df, us: df.select(*key(df), us.alias("__us"), F.struct(*(f"`{c}`" for c in df.columns)).alias("__row"))
    l = inner(left, micros(time))
    r = right.select(*key(right), micros(time).alias("__us"), F.col(f"`{ties}`").alias("__tie"), F.struct(*(f"`{c}`" for c in right.columns)).alias("__m")).where("__us IS NOT NULL")
    l, r = l.select("*", stretch), r.select("*", stretch)
    last = r.groupBy(*keys, "__stretch").agg(F.max_by(F.struct("__us", "__m"), F.struct("__us", "__tie")).alias("__last"))
    # which stretches have left rows, and what the last right row before each of them was
    points = l.where("__us IS NOT NULL").select(*keys, "__stretch").distinct().select("*", F.lit(None).cast(last.schema["__last"].dataType).alias("__last"), F.lit(True).alias("__asked"))
    steps = points.unionByName(last.withColumn("__asked", F.lit(False))).groupBy(*keys, "__stretch").agg(F.first("__last", ignorenulls=True).alias("__last"), F.bool_or("__asked").alias("__asked"))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__came", F.last("__last", ignorenulls=True).over(earlier)).where("__asked AND __came IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)
    m, tie, row = r.schema["__m"].dataType, r.schema["__tie"].dataType, l.schema["__row"].dataType
    both = (
        l.select(*keys, "__stretch", F.col("__us").alias("__o"), F.lit(1).alias("__kind"), none(tie).alias("__tie"), none(m).alias("__m"), F.col("__us"), "__row")
        .unionByName(r.select(*keys, "__stretch", F.col("__us").alias("__o"), F.lit(0).alias("__kind"), "__tie", "__m", "__us", none(row).alias("__row")))
        .unionByName(carried.select(*keys, "__stretch", F.lit(_BEFORE_ALL).alias("__o"), F.lit(0).alias("__kind"), none(tie).alias("__tie"), F.col("__came.__m").alias("__m"), F.col("__came.__us").alias("__us"), none(row).alias("__row")))
    )
    frame = Window.partitionBy(*keys, "__stretch").orderBy("__o", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__hit", F.last(F.when(F.col("__kind") == 0, F.struct("__us", "__m")), ignorenulls=True).over(frame)).where("__kind = 1")
    near = F.col("__us").isNotNull() if tolerance_us is None else F.col("__us") - F.col("__hit.__us") <= tolerance_us
    return met.select("__row.*", F.when(near, F.col("__hit.__m")).alias(name))


def interval_join(left: DataFrame, right: DataFrame, before_us: int, after_us: int, time: str = "ts", by: Sequence[str] = (), name: str = "m", width_us: int | None = None) -> DataFrame:
    """(left's columns, name): a row for each right row of the key with a time in [time - before_us, time + after_us].

    Left rows are copied to each stretch that their interval meets, two or three with stretches of its width; right rows lie
    in one. Rows of unknown time meet nothing; missing keys match missing keys.
    """
    width = width_us or max(1, before_us + after_us)
    keys = [f"__k{i}" for i in range(len(by))]
    key = lambda c, k: F.struct(F.col(f"`{c}`").alias("v")).alias(k)  # noqa: E731  a struct of null is not null
    span = F.sequence(F.floor((F.col("__us") - before_us) / width), F.floor((F.col("__us") + after_us) / width))
    l = left.select(F.struct(*(f"`{c}`" for c in left.columns)).alias("__row"), micros(time).alias("__us"), *(key(c, k) for c, k in zip(by, keys, strict=True)))
    l = l.where("__us IS NOT NULL").select("*", F.explode(span).alias("__stretch"))
    r = right.select(F.struct(*(f"`{c}`" for c in right.columns)).alias("__m"), micros(time).alias("__at"), *(key(c, k) for c, k in zip(by, keys, strict=True))).where("__at IS NOT NULL")
    met = l.join(r.withColumn("__stretch", F.floor(F.col("__at") / width)), [*keys, "__stretch"])
    return met.where(F.col("__at").between(F.col("__us") - before_us, F.col("__us") + after_us)).select("__row.*", F.col("__m").alias(name))
