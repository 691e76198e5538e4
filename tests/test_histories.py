from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from calltide.operators import evaluate, expansion, reconcile, sketches
from pyspark.sql import functions as F


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_a_feed_applied_gives_the_new_log(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "COPIES_AT_ONCE", 7)
    rng = random.Random(4)
    row = lambda: (rng.choice((None, *range(12))), rng.choice((None, "x", "y")), rng.choice((None, 1.5, 2.5)))
    schema = "k long, copies string, op double"  # names that the feed uses itself
    for _ in range(3):
        old = [row() for _ in range(80)] + [(99, "hot", 0.5)] * 40
        new = [r for r in old if rng.random() < 0.8] + [row() for _ in range(30)] + [(99, "hot", 0.5)] * 33
        a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
        feed = reconcile.change_feed(a, b, "k")
        assert bag(reconcile.apply_feed(a, feed)) == Counter(new)
        rows = feed.collect()
        gone, came = Counter(old) - Counter(new), Counter(new) - Counter(old)
        assert sum(r.copies for r in rows if r.before is not None) == sum(gone.values()) and sum(r.copies for r in rows if r.after is not None) == sum(came.values())
        per_key = lambda c: Counter(k for (k, _, _), n in c.items() for _ in range(n))
        single = {k for k in per_key(gone) if per_key(gone)[k] == 1 == per_key(came)[k]}
        assert {r.key for r in rows if r.op == "update"} == single and all(r.op != "update" or (r.before.k, r.after.k) == (r.key, r.key) for r in rows)
    empty = a.where("false")
    assert reconcile.change_feed(a, a, "k").count() == 0
    assert bag(reconcile.apply_feed(a, reconcile.change_feed(a, empty, "k"))) == Counter()
    assert bag(reconcile.apply_feed(empty, reconcile.change_feed(empty, b, "k"))) == Counter(new)


def test_sketches_stay_within_their_bounds(spark):
    rng = random.Random(7)
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(hours=rng.randrange(24 * 20)), rng.randrange(30_000), rng.gauss(0, 1) ** 3) for _ in range(40_000)] + [(None, 1, 1.0), (t0, None, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, who long, v double")
    days = sketches.daily(df, "ts", F.col("who"), F.col("v"))
    assert days.count() == 20
    span = sketches.merged(days, 5)
    told = {r.day: r for r in span.select("day", "calls", sketches.distinct_estimate().alias("about"), *(sketches.quantile_estimate(p).alias(f"q{k}") for k, p in enumerate((0.05, 0.5, 0.99))), sketches.rank_estimate(F.lit(0.0)).alias("below")).collect()}
    for day, r in told.items():
        own = [x for x in rows if x[0] is not None and timedelta(0) <= day - x[0].date() < timedelta(days=5)]
        users, values = {w for _, w, _ in own if w is not None}, sorted(v for *_, v in own if v is not None)
        assert r.calls == len(own) and abs(r.about - len(users)) <= sketches.DISTINCT_ERROR * len(users)
        for k, p in enumerate((0.05, 0.5, 0.99)):
            assert abs(sum(v <= r[f"q{k}"] for v in values) / len(values) - p) <= sketches.RANK_ERROR + 1 / len(values)
        assert abs(r.below - sum(v <= 0 for v in values) / len(values)) <= sketches.RANK_ERROR
    # sketches of parts of a day merge to the day's
    halves = sketches.daily(df.where("who % 2 = 0"), "ts", F.col("who"), F.col("v")).unionByName(sketches.daily(df.where("NOT coalesce(who % 2 = 0, false)"), "ts", F.col("who"), F.col("v")))
    both = {r.day: (r.calls, r.about) for r in sketches.merged(halves, 1).select("day", "calls", sketches.distinct_estimate().alias("about")).collect()}
    for r in days.select("day", "calls", sketches.distinct_estimate().alias("about")).collect():
        assert both[r.day][0] == r.calls and abs(both[r.day][1] - r.about) <= 2 * sketches.DISTINCT_ERROR * r.about


def test_cube_tells_totals_from_null_groups(spark):
    rows = [("a", None, "abcd"), ("a", "v", "ab"), ("a", "v", ""), (None, "v", "a"), ("b", "v", "abcd")]
    df = spark.createDataFrame(rows, "condition string, variant string, response string")
    got = {(r.condition, r.variant, r.level): (r.mean_score, r.mean_hits, r.n, r.delta) for r in evaluate.condition_cube(df, ["condition", "variant"], [["condition", "variant"], ["condition"], []], "variant", markers=("a", "b", "c", "d")).collect()}
    assert got == {
        ("a", None, 0): (1.0, 4.0, 1, 0.5), ("a", "v", 0): (0.25, 1.0, 2, -0.25), (None, "v", 0): (0.25, 1.0, 1, 0.0), ("b", "v", 0): (1.0, 4.0, 1, 0.0),
        ("a", None, 1): (0.5, 2.0, 3, 0.0), (None, None, 1): (0.25, 1.0, 1, 0.0), ("b", None, 1): (1.0, 4.0, 1, 0.0), (None, None, 3): (0.55, 2.2, 5, 0.0),
    }


def test_seeds_expand_to_rows_and_errors(spark, tmp_path):
    asked = str(tmp_path)

    def model(text):
        import uuid

        open(f"{asked}/{uuid.uuid4().hex}", "w").close()
        if text == "bad":
            raise ValueError("no")
        return text.split()

    rows = [(1, "x y"), (2, "bad"), (3, None), (4, ""), *((k, "same text here") for k in range(10, 60)), (1, "x y")]
    got = expansion.expand(spark.createDataFrame(rows, "n long, t string"), "n", "t", model, salts=2).collect()
    found = Counter((r.id, r.place, r.item, r.error) for r in got)
    want = Counter({(2, None, None, "ValueError: no"): 1, (3, None, None, "no text"): 1, (1, 0, "x", None): 2, (1, 1, "y", None): 2})
    want.update((k, p, w, None) for k in range(10, 60) for p, w in enumerate(("same", "text", "here")))
    assert found == want
    assert len(list(tmp_path.iterdir())) <= 5  # once for each text and salt
