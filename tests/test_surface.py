from __future__ import annotations

from datetime import datetime

from calltide.functions.values import age_days, budget_band, recency
from calltide.operators import gates
from calltide.plans import surface
from pyspark.sql import functions as F

CALLS = [(1, "audit", "One QUERY", None), (2, None, "two", "a Response"), (3, "audit", None, None)]


def install(spark):
    rows = [(datetime(2026, 5, d), c, h) for d, c, h in ((1, 2.0, 0.5), (3, None, 0.25), (6, 4.0, None))]
    metrics = spark.createDataFrame(rows, "ts timestamp_ntz, cost_usd double, maintenance_hours double")
    baseline = spark.createDataFrame([(datetime(2026, 5, 2), 2.0), (datetime(2026, 5, 5), 2.0)], "ts timestamp_ntz, cost_usd double")
    surface.install(spark, spark.createDataFrame(CALLS, "seq long, label string, query string, response string"), metrics, baseline)
    return metrics, baseline


def test_functions_are_those_of_the_library(spark):
    metrics, baseline = install(spark)
    then = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2026-05-01', TIMESTAMP_NTZ '2026-03-01', NULL)) AS t")
    now = F.lit(datetime(2026, 5, 8)).cast("timestamp_ntz")
    for row in then.select(F.expr("calltide_recency(t, TIMESTAMP_NTZ '2026-05-08')").alias("a"), recency(age_days(now, "t")).alias("b"), F.expr("calltide_recency(t, TIMESTAMP_NTZ '2026-05-08', decay_days => 300)").alias("c")).collect():
        assert row.a == row.b <= row.c
    banded = spark.sql("SELECT explode(array(0.1D, 1.4D, 1.5D, 9D, NULL)) AS v").select(F.expr("calltide_band(v, 1.5, 1.35)").alias("a"), budget_band(F.col("v"), 1.5, 1.35).alias("b")).collect()
    assert all(r.a == r.b for r in banded) and len({r.a for r in banded}) == 4
    got = spark.sql("SELECT * FROM calltide_gates(moment => TIMESTAMP_NTZ '2026-05-08')").first()
    want = gates.cost_ratio(metrics, baseline, now).first()
    assert (got.wrapped_calls, got.baseline_calls, got.ratio, got.ratio_status) == (want.wrapped_calls, want.baseline_calls, want.ratio, want.ratio_status) == (3, 2, 1.5, "warn")
    assert got.hours == gates.hours_used(metrics, now).first().hours == 0.75
    none = spark.sql("SELECT * FROM calltide_gates(TIMESTAMP_NTZ '2020-01-01', days => 1)").first()
    assert tuple(none) == (0, 0, None, 0.0, "unknown")


def test_search_and_latest(spark):
    install(spark)
    found = lambda needle: sorted(r.seq for r in spark.sql("SELECT seq FROM calltide_search(needle => :n)", {"n": needle}).collect())
    assert found("query") == [1] and found("RESPONSE") == [2] and found("audit") == [1, 3] and found(" ") == [1, 2, 3] and found("none of them") == []
    assert sorted((r.label or "", r.place, r.seq) for r in spark.sql("SELECT * FROM calltide_latest()").collect()) == [("", 1, 2), ("audit", 1, 3)]
    assert spark.sql("SELECT * FROM calltide_latest(per_label => 2)").count() == 3
    assert [r.s for r in spark.sql("SELECT calltide_score(query, array('o', 'e', 'zz')) AS s FROM calltide_calls ORDER BY seq").collect()] == [0.5, 0.25, 0.0]
