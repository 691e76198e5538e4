from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from calltide.operators import gates, intime
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
HOURS = lambda h: T0 + timedelta(hours=h)


def us(t):
    return None if t is None else round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)


def test_rolling_sums_are_those_of_the_frame(spark):
    rng = random.Random(1)
    rows = [(HOURS(rng.randrange(0, 400) / 4), rng.choice((None, 1, 5, 7))) for _ in range(300)] + [(None, 100), (datetime(1969, 12, 31, 23), 3)]
    other = [(HOURS(50), 11), (HOURS(43), 13)]
    points = [(i, HOURS(h)) for i, h in enumerate([0, 7.0, 50, 50, 50.25, 99, 1e5])] + [(90, None), (91, datetime(1970, 1, 1, 3))]
    a = spark.createDataFrame(rows, "t timestamp_ntz, v long")
    b = spark.createDataFrame(other, "at timestamp_ntz, w long")
    p = spark.createDataFrame(points, "id long, ts timestamp_ntz")
    series = [(a, "t", {"n": F.lit(1).cast("long"), "v": F.col("v")}), (b, "at", {"w": F.col("w")})]
    for width in (intime.HOUR_US, 50 * intime.HOUR_US, 1_000_000_000_000_000):
        got = {r.id: (r.n, r.v, r.w) for r in intime.rolling(p, "id", "ts", series, 7 * intime.HOUR_US, width).collect()}
        assert len(got) == len(points)
        for i, t in points:
            inside = lambda x: x is not None and t - timedelta(hours=7) <= x <= t  # noqa: E731, B023
            want = (sum(inside(x) for x, _ in rows), sum(v or 0 for x, v in rows if inside(x)), sum(v for x, v in other if inside(x))) if t else (None, None, None)
            assert got[i] == want, (width, i)
    assert intime.rolling(p.where("false"), "id", "ts", series, 1).count() == 0
    assert intime.rolling(p, "id", "ts", [(a.where("false"), "t", {"n": F.lit(1).cast("long")})], 1).where("n = 0").count() == len(points) - 1


@pytest.mark.parametrize("n", [1, 2, 5])
def test_last_rows_over_chunks(spark, n):
    rng = random.Random(n)
    order = rng.sample(range(1000), 200)
    df = spark.createDataFrame([(s, s % 7) for s in order], "seq long, v long")
    want = sorted(order)
    for chunk in (1, 3, 40, 1000):
        got = {r.seq: [x.seq for x in r["last"]] for r in intime.last_n(df, ["seq"], n, chunk).collect()}
        assert got == {s: want[max(0, k + 1 - n) : k + 1] for k, s in enumerate(want)}, chunk
    assert intime.last_n(df.where("false"), ["seq"], n).count() == 0


def asof_brute(left, right, tolerance=None):
    out = []
    for i, k, t in left:
        best = None
        for seq, rk, rt, v in right:
            if t is not None and rt is not None and rk == k and rt <= t and (tolerance is None or t - rt <= tolerance):
                best = max(best or (rt, seq, v), (rt, seq, v))
        out.append((i, best and best[2]))
    return sorted(out)


def test_asof_join(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    time = lambda: rng.choice([None, *[HOURS(rng.randrange(0, 600) / 8) for _ in range(12)]])
    left = [(i, key(), time()) for i in range(300)] + [(900, "a", HOURS(-5)), (901, "unknown", HOURS(5)), (902, "hot", HOURS(1000))]
    right = [(i, key(), time(), f"v{i}") for i in range(200)] + [(500, "hot", HOURS(10), "tie1"), (501, "hot", HOURS(10), "tie2")]
    l = spark.createDataFrame([(*r, "clash") for r in left], "i long, k string, ts timestamp_ntz, m string")
    r = spark.createDataFrame(right, "seq long, k string, ts timestamp_ntz, v string")
    for tolerance, width in ((None, intime.HOUR_US), (None, intime.DAY_US), (timedelta(hours=2), intime.HOUR_US // 4), (timedelta(0), 9 * intime.DAY_US)):
        got = intime.asof_join(l, r, by=["k"], name="found", tolerance_us=None if tolerance is None else round(tolerance.total_seconds() * 1e6), width_us=width)
        assert got.columns == ["i", "k", "ts", "m", "found"]
        assert sorted((x.i, x.found and x.found.v) for x in got.collect()) == asof_brute(left, right, tolerance)
    assert all(x.found is None for x in intime.asof_join(l, r.where("false"), by=["k"], name="found").collect())
    assert intime.asof_join(l.where("false"), r, by=["k"]).count() == 0
    alone = [(i, None, t) for i, _, t in left], [(s, None, t, v) for s, _, t, v in right]
    assert sorted((x.i, x.m and x.m.v) for x in intime.asof_join(l.drop("m"), r).collect()) == asof_brute(*alone)


def test_a_hot_key_is_dealt_by_time(spark):
    """One key of 20,000 rows: no task of the join's windows gets a tenth of it."""
    rows = spark.range(20_000).selectExpr("id AS seq", "'hot' AS k", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts")
    joined = intime.asof_join(rows, rows, by=["k"])
    assert joined.where("m.seq = seq").count() == 20_000
    spread = rows.groupBy("k", F.floor(intime.micros("ts") / intime.HOUR_US)).count()
    assert spread.agg(F.max("count")).first()[0] == 60


def test_interval_join(spark):
    rng = random.Random(5)
    key = lambda: rng.choice(["a", "b", None])
    left = [(i, key(), rng.choice((None, HOURS(rng.randrange(0, 400) / 8)))) for i in range(120)]
    right = [(i, key(), rng.choice((None, HOURS(rng.randrange(0, 400) / 8)))) for i in range(120)]
    l, r = (spark.createDataFrame(x, "i long, k string, ts timestamp_ntz") for x in (left, right))
    want = sorted((i, j) for i, k, t in left for j, rk, rt in right if None not in (t, rt) and k == rk and t - timedelta(hours=2) <= rt <= t + timedelta(hours=1))
    for width in (None, intime.HOUR_US // 3, intime.DAY_US):
        got = intime.interval_join(l, r, 2 * intime.HOUR_US, intime.HOUR_US, by=["k"], width_us=width)
        assert sorted((x.i, x.m.i) for x in got.collect()) == want


def test_history_is_the_verdict_at_each_row(spark):
    rng = random.Random(6)
    metrics = [(i, HOURS(8 * i + rng.randrange(3)), rng.choice((None, 0.25, 0.5, 1.5)), rng.choice((True, False, None)), rng.choice((0.05, 0.1, None))) for i in range(40)]
    base = [(HOURS(rng.randrange(0, 320)), rng.choice((0.25, 0.5))) for _ in range(60)]
    m = spark.createDataFrame(metrics, "seq long, ts timestamp_ntz, cost_usd double, conclusion_changed boolean, maintenance_hours double")
    b = spark.createDataFrame(base, "ts timestamp_ntz, cost_usd double")
    limits = gates.Limits()
    told = {r.seq: r for r in gates.history(m, b, limits).collect()}
    assert len(told) == 40 and len({r.verdict for r in told.values()}) > 1
    for seq in (0, 3, 4, 17, 39):
        now = metrics[seq][1]
        want = gates.verdict(m.where(F.col("seq") <= seq), b.where(F.col("ts") <= F.lit(now).cast("timestamp_ntz")), F.lit(now).cast("timestamp_ntz"), limits).first()
        for name in ("wrapped_calls", "baseline_calls", "ratio", "flagged", "flag_status", "hours", "verdict", "exit_code", "issues", "warnings"):
            assert told[seq][name] == want[name], (seq, name)
