from __future__ import annotations

import random

from calltide.operators import campaign, distill, documents, evaluate, intime
from calltide.plans import reports
from pyspark.sql import functions as F


def test_numbers_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(9)) for k in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k long, v int")
    for chunk in (7, 64, 10_000):
        got = {r.k: r.idx for r in intime.numbered(df, [F.desc("v"), "k"], chunk_rows=chunk).collect()}
        assert got == {k: n for n, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert intime.numbered(df.where("false"), ["k"]).count() == 0
    assert sorted(r.idx for r in evaluate.with_index(df, ["k"]).collect()) == list(range(200))


def test_mixing_is_repeatable(spark):
    a, b = spark.createDataFrame([(f"a{k}",) for k in range(20)], "query string"), spark.createDataFrame([(f"b{k}",) for k in range(20)] + [(None,)], "query string")
    order = [r["query"] for r in distill.mix(a, b).collect()]
    placed = [r["query"] for r in distill.mixed(b, a).orderBy("place").collect()]
    assert order == placed and order != sorted(order, key=lambda x: x or "") and len({x and x[0] for x in order[:12]}) > 1
    assert [r["query"] for r in distill.mix(a, b, seed=7).collect()] != order


def test_contexts_of_many_projects_are_those_of_one(spark):
    projects = [("p", "go", '{"a":[1]}', "# Log\n## Turn 2\nb\n## Turn 1\na\n"), ("q", None, "no json", None), ("r", "only", None, None)]
    rules = [("p", "z.md", "last"), ("p", "book.md", "long"), ("p", "book.digest.md", "short"), ("q", "book.md", "its own"), ("other", "x.md", "y"), ("q", "lost.digest.md", "no book")]
    r = spark.createDataFrame(rules, "project string, name string, text string")
    got = {x.project: x.context for x in documents.project_contexts(spark.createDataFrame(projects, "project string, mission string, tasks string, turn_log string"), r).collect()}
    for project, *files in projects:
        assert got[project] == documents.project_context(*files, r.where(r.project == project).select("name", "text")).first().context
    assert "short" in got["p"] and "long" not in got["p"] and got["q"] == "### rules/book.md\n\nits own\n"


def test_health_of_projects(spark):
    checks = [("a", 1, "pdf", "ok"), ("a", 0, "sheets", "missing: x"), ("a", 2, "writable", "false"), ("b", 0, "pdf", "true"), (None, 0, "pdf", "missing")]
    got = {r.project: (r.ok, r.checks, r.issues) for r in campaign.health_of(spark.createDataFrame(checks, "project string, place int, name string, value string")).collect()}
    assert got["a"] == (False, {"pdf": "ok", "sheets": "missing: x", "writable": "false"}, ["sheets", "writable"])
    assert got["b"] == (True, {"pdf": "true"}, []) and got[None][2] == ["pdf"]


def test_sheet_rows_are_the_sheet(spark):
    entries = spark.createDataFrame([(k, f"orchard ladder entry{k}") for k in range(3)], "seq int, query string")
    targets = spark.createDataFrame([(0, "orchard ladder"), (1, "nothing alike")], "idx int, query string")
    options = {"min_score": 1.0, "rare_below": 1.01}
    sheet = reports.score_sheet(targets, entries, F.lit(0.0), **options)
    rows = reports.score_sheet_rows(targets, entries, F.lit(0.0), **options).orderBy("idx").collect()
    assert sheet == "# Precision sheet\n\n" + "\n".join(r.section for r in rows)


def test_pictures_and_numbers_in_clean_markdown(spark):
    md = "**----- Start of picture text -----**<br>\n2.1 Moves<br>**----- End of picture text -----**<br>\n  **==> picture [x] intentionally omitted <==**\n**==> picture [x] intentionally omitted <==**\nBANNER\ntext\nBANNER\n 12 \nPage 3\nBANNER\nmore\nBANNER\n"
    got = spark.createDataFrame([(md,)], "md string").select(documents.clean_markdown("md").alias("c")).first().c
    assert got.startswith("### 2.1 Moves") and "BANNER" not in got and "Page 3" not in got and "\n 12" not in got and got.count("omitted") == 1
