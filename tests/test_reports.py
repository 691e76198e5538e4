from __future__ import annotations

import json

from calltide.functions.text import checkboxes
from calltide.operators import evaluate
from calltide.plans import reports
from pyspark.sql import functions as F


def test_reports(spark, tmp_path):
    means = spark.createDataFrame([("strategic", "student", 0.956, 40), ("strategic", "gold", 1.0, 40), ("forgetting", "student", 0.0, 30)], "kind string, condition string, mean_score double, n long")
    text = reports.evaluation_summary(means, evaluate.score_verdict(means.where("kind = 'strategic'")), "2026-05-09")
    assert "| student   | 0.956      | 40 |" in text and "student/gold: 0.96, PASS" in text and "ablation" not in text
    rows = spark.createDataFrame([("student", "v1", "trade"), ("student", "v2", "trade scope structural"), ("ablation", "v2", "scope")], "condition string, variant string, response string")
    pivot = evaluate.condition_pivot(rows, ["v1", "v2"])
    best = evaluate.best_variant(pivot.where("condition = 'student'").select(F.lit(0).alias("position"), F.lit("v2").alias("variant"), F.col("v2_delta").alias("delta")))
    text = reports.comparison(pivot, evaluate.adapter_signal(pivot, ["v1", "v2"]), best, ["v1", "v2"])
    assert "LAUNCH SWAP: v2 with +2.00" in text and "- v2: +2.00 (+1.00 against v1)" in text
    judged = evaluate.judge(spark.createDataFrame([(1, "q" * 90, "A", "a."), (0, "r", "A", "B")], "idx int, query string, candidate_slot string, raw_judge string"))
    report = reports.judge_report(evaluate.outcome_summary(judged), judged)
    assert report["outcomes"] == {"candidate_wins": 1, "baseline_wins": 1} and report["win_rate_without_ties"] == 0.5 and [len(d["query"]) for d in report["details"]] == [1, 80]
    reports.write_json(spark, f"{tmp_path}/r.json", report)
    assert json.loads((tmp_path / "r.json").read_text()) == report
    entries = spark.createDataFrame([(k, f"orchard ladder entry{k}") for k in range(3)], "seq int, query string")
    targets = spark.createDataFrame([(0, "orchard ladder"), (1, "nothing alike")], "idx int, query string")
    sheet = reports.score_sheet(targets, entries, F.lit(0.0), min_score=1.0, rare_below=1.01)
    assert sheet.count("- [ ] **match 1.") == 3 and "_(no matches)_" in sheet
    ticked = spark.createDataFrame([(sheet.replace("[ ] **match 1.1", "[x] **match 1.1"),)], "t string").select(F.explode(checkboxes("t")).alias("box"))
    assert evaluate.precision(ticked).first().precision == 1 / 3
    assert [r.name for r in reports.missing_files(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a",)], "name string")).collect()] == ["b"]
