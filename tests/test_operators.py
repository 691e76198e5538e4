from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from calltide.operators import calls, campaign, distill, documents, evaluate, gates, orders, relevance
from calltide.sources import readers, sinks


def now():
    return F.to_timestamp(F.lit("2026-05-08 00:00:00"))


def entries(spark, rows):
    return spark.createDataFrame([(k, q, t) for k, (q, t) in enumerate(rows)], "seq int, query string, ts string").withColumn("ts", F.to_timestamp("ts"))


def test_relevance_ranking(spark):
    """Scores are shared tokens times what is left of 30 days: 2 * 28/30, 1 * 29/30, 3 * 6/30; the rest shares nothing or has no time."""
    rows = [("apples pears plums", "2026-04-14"), ("violin cello", "2026-05-06"), ("apples pears", "2026-05-06"), ("plums violin", "2026-05-07"), ("apples pears plums", None), ("apples pears plums", "2026-03-01")]
    df = entries(spark, rows)
    got = [(r.seq, round(r.score, 6)) for r in relevance.top_entries(df, "Plums, apples and PEARS", now(), min_score=0.5, rare_below=1.01).collect()]
    assert got == [(2, round(2 * 28 / 30, 6)), (3, round(29 / 30, 6)), (0, round(3 * 6 / 30, 6))]
    assert relevance.top_entries(df, "which of the two", now(), min_score=0.0, rare_below=1.01).count() == 0  # stop words only
    assert relevance.top_entries(df, "apples", now(), min_score=0.1).count() == 0  # of few entries no token is rare
    same = entries(spark, [("violin cello", "2026-05-08")] * 7)
    assert [r.seq for r in relevance.top_entries(same, "cello violin", now(), min_score=1.0, rare_below=1.01).collect()] == [0, 1, 2]


def test_both_forms_of_relevance_agree(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(40)]
    df = entries(spark, [(" ".join(rng.choice(words) for _ in range(8)), f"2026-04-{rng.randint(10, 30)}") for _ in range(60)])
    from calltide.functions.values import age_days

    queries = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(6))) for k in range(5)], "q int, text string")
    many = relevance.rank(queries, df, "q", "text", "seq", "query", age_days(now(), "ts"), min_score=0.3, rare_below=0.2).collect()
    for q in queries.collect():
        one = relevance.top_entries(df, q.text, now(), min_score=0.3, rare_below=0.2).collect()
        assert [(r.seq, r.score) for r in one] == [(r.seq, r.score) for r in sorted(many, key=lambda r: r["rank"]) if r.q == q.q]


def test_budget_prefix_stops_at_the_first_that_breaks_it(spark):
    df = spark.createDataFrame([(0, 100), (1, 200), (2, 300), (3, 50)], "rank int, cost int")
    assert [r["rank"] for r in relevance.budget_prefix(df, "cost", 350, ["rank"]).collect()] == [0, 1]
    assert [r["rank"] for r in relevance.budget_prefix(df, "cost", 300, ["rank"]).collect()] == [0, 1]
    rows = [(k, f"2026-05-0{k + 1}T00:00:00Z", "audit", "q" * 1000, "r" * 2000, ["01", "2"]) for k in range(5)]
    calls_ = spark.createDataFrame(rows, "rank int, timestamp string, template string, query string, response string, retrieved_corpus_ids array<string>")
    got = relevance.preamble(calls_, [1, 2], max_tokens=1000).first()
    assert got.matches == 3 and "shared corpus IDs: [1, 2]" in got.preamble and got.tokens <= 1100
    assert relevance.preamble(calls_.limit(0), [1]).first().matches == 0


def metrics(spark, rows):
    return spark.createDataFrame(rows, "seq int, ts string, cost_usd double, conclusion_changed boolean, maintenance_hours double").withColumn("ts", F.to_timestamp("ts"))


def test_gates(spark):
    base = metrics(spark, [(0, "2026-05-07", 1.0, None, None)])
    calm = metrics(spark, [(k, "2026-05-07", 1.0, k % 2 == 0, 0.1) for k in range(6)])
    one = gates.verdict(calm, base, now()).first()
    assert (one.verdict, one.exit_code, one.ratio, one.flagged) == ("EXTEND", 1, 1.0, 2) and one.warnings == ["conclusion_changed"]
    fine = metrics(spark, [(k, "2026-05-07", 1.0, True, 0.1) for k in range(6)])
    assert gates.verdict(fine, base, now()).first().verdict == "CONTINUE"
    dear = metrics(spark, [(k, "2026-05-07", 1.6, True, 0.5) for k in range(6)])
    assert gates.verdict(dear, base, now()).first().issues == ["cost_ratio", "maintenance_hours"]
    none = gates.verdict(fine.limit(0), base, now()).first()
    assert none.verdict == "EXTEND" and none.ratio is None and none.warnings == ["cost_ratio", "conclusion_changed"]
    old = metrics(spark, [(9, "2026-04-30 23:59:59", 50.0, True, 9.0)])
    assert gates.verdict(fine.unionByName(old), base, now()).first().verdict == "CONTINUE"
    zero = metrics(spark, [(0, "2026-05-07", 0.0, None, None)])
    assert gates.verdict(fine, zero, now()).first().ratio_status == "unknown"


CALLS = [
    {"timestamp": "2026-03-10T08:00:00Z", "query": "alpha", "template": "plan", "preamble_tokens": 12, "cost_usd": 0.5, "retrieved_corpus_ids": ["03"]},
    {"timestamp": "2026-03-11T08:00:00Z", "mode": "wargame-vision", "query": "beta", "model": "v", "preamble_text_tokens": 0, "usage": {"cost": 2.0, "total_cost": 3.0}, "images": ["map.png"], "cost_usd": None},
    {"timestamp": "2026-03-12T08:00:00Z", "mode": "wargame-vision", "model": None, "usage": {"cost": 2.0}},
    {"query": None, "cost_usd": "4"},
]
CALL_METRICS = [
    {"timestamp": "2026-03-11T08:00:00Z", "cost_usd": 9.0, "exit_code": 2},
    {"timestamp": "2026-03-11T08:00:00Z", "cost_usd": 1.25, "exit_code": 0, "preamble_tokens": 33, "image_count": 1},
    {"timestamp": "2026-03-10T08:00:00Z", "conclusion_changed": True, "exit_code": 0},
    {"conclusion_changed": "true", "maintenance_hours": True},
]


def test_logs_end_to_end(spark, tmp_path):
    (tmp_path / "calls.jsonl").write_text("".join(json.dumps(c) + x for c, x in zip(CALLS, ("\n{broken\n", "\n\n", "\n", "\n"), strict=True)))
    (tmp_path / "metrics.jsonl").write_text("\n".join(map(json.dumps, CALL_METRICS)) + "\n")
    raw = readers.read_calls(spark, f"{tmp_path}/calls.jsonl")
    measured = readers.read_metrics(spark, f"{tmp_path}/metrics.jsonl")
    rows = calls.load(raw, measured)
    got = rows.orderBy("seq").collect()
    assert [(r.kind, r.label, r.tokens, r.cost_usd, r.exit_code, r.conclusion_changed) for r in got] == [
        ("audit", "plan", 12, 0.5, 0, True), ("vision", "v", 33, 1.25, 0, None), ("vision", None, 0, 2.0, None, None), ("audit", "", 0, None, None, None)
    ]
    assert [r.query for r in got] == ["alpha", "beta", "", None] and {r.response for r in got} == {""}  # null in the log stays null, missing is empty
    assert [r.usage_total_cost for r in raw.orderBy("seq").collect()] == [None, 3.0, None, None]
    assert got[1].images == ["map.png"] and got[0].images == []
    assert [r.query for r in calls.page(rows, 2, 1).collect()] == ["", "beta"]
    assert [r.timestamp for r in calls.load_page(raw, measured, 2).collect()] == [None, "2026-03-12T08:00:00Z"]
    assert calls.search(rows, "ALPHA").count() == 1 and calls.search(rows, " ").count() == 4
    assert calls.lookup(rows, "2026-03-10T08:00:00Z").first()["query"] == "alpha" and calls.lookup(rows, "x").count() == 0
    assert [r.cost_usd for r in calls.sort(rows, "cost_usd", False).collect()] == [0.5, 1.25, 2.0, None] and [r.cost_usd for r in calls.sort(rows, "cost_usd").collect()] == [2.0, 1.25, 0.5, None]
    assert [r.maintenance_hours for r in measured.orderBy("seq").collect()] == [None, None, None, 1.0]
    assert readers.read_jsonl(spark, f"{tmp_path}/missing.jsonl").count() == 0
    both = calls.union_logs(rows.select("seq", "query"), rows.select("seq", "label"))
    assert both.count() == 8 and both.orderBy("seq").first()["query"] == "alpha"


def test_flag_update_and_appends(spark, tmp_path):
    path = f"{tmp_path}/m"
    rows = spark.createDataFrame([("a", None, "é"), ("a", True, "x"), ("b", False, "y")], "timestamp string, conclusion_changed boolean, note string")
    sinks.append_jsonl(rows, path)
    sinks.append_jsonl(spark.createDataFrame([("c", "z")], "timestamp string, note string"), path)
    assert sinks.update_flag(spark, path, "a", True) == 2 and sinks.update_flag(spark, path, "c", None) == 1
    with pytest.raises(KeyError):
        sinks.update_flag(spark, path, "nope", True)
    got = {(r.timestamp, r.note): r.conclusion_changed for r in spark.read.json(path).collect()}
    assert got == {("a", "é"): True, ("a", "x"): True, ("b", "y"): False, ("c", "z"): None}
    nested = {"timestamp": "n", "inner": {"conclusion_changed": False, "big": 12345678901234567890, "s": "\"q\" \\ é"}, "note": 'says "conclusion_changed": true'}
    sinks.overwrite_jsonl(spark.createDataFrame([("m", "1")], "timestamp string, note string"), path)
    spark.createDataFrame([(json.dumps(nested),), ("broken",)], "value string").write.mode("append").text(path)
    assert sinks.update_flag(spark, path, "n", True) == 1
    lines = {json.loads(r.value)["timestamp"]: json.loads(r.value) for r in spark.read.text(path).collect()}
    assert lines == {"m": {"timestamp": "m", "note": "1"}, "n": nested | {"conclusion_changed": True}}


def test_a_failed_swap_keeps_the_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.append_jsonl(spark.createDataFrame([("a",)], "timestamp string"), path)
    with pytest.raises(OSError, match="unchanged"):
        sinks._swap(spark, f"{tmp_path}/not-there", path)
    assert spark.read.json(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_sources_can_be_deleted_and_turn_logs_grow(spark, tmp_path):
    for name in ("rules/book.md", "rules/book.pdf", "rules/book.digest.md", "reference/map.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = readers.files(spark, str(tmp_path / "rules"))
    assert [(r.name, r.source) for r in readers.source_list(found, found).collect()] == [("book.md", "converted from pdf")]
    assert sinks.delete_source(spark, str(tmp_path), "rules", "book.md") == ["book.md", "book.pdf"]
    assert sinks.delete_source(spark, str(tmp_path), "reference", "map.png") == ["map.png"]
    assert (tmp_path / "rules" / "book.digest.md").exists()
    for kind, name, error in (("rules", "book.md", FileNotFoundError), ("rules", "../x", ValueError), ("other", "x", ValueError), ("rules", " ", ValueError)):
        with pytest.raises(error):
            sinks.delete_source(spark, str(tmp_path), kind, name)
    log = tmp_path / "turn-log.md"
    sinks.append_narrative(spark, str(log), "\n## Turn 1\n")
    sinks.append_narrative(spark, str(log), "\n## Turn 2\n")
    assert log.read_text() == "# Turn log\n\n---\n\n## Turn 1\n\n## Turn 2\n"


def test_scans_with_an_injected_command(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "fails"), (3, "raises")], "id int, query string")

    def show_prompt(text):
        if text == "raises":
            raise OSError("gone")
        return {"output": "## Reference: corpus #12\n## Reference: corpus #3\n## Reference: corpus #12", "code": int(text == "fails")}

    got = {r.id: (r.ids, r.error) for r in readers.scan_corpus_ids(rows, "query", show_prompt).collect()}
    assert got == {1: ([3, 12], None), 2: (None, "exit code 1"), 3: (None, "OSError: gone")}


def test_checks_that_fail_a_query(spark):
    from calltide.functions import text as T

    df = spark.createDataFrame([(10,), (11,)], "n long")
    assert [r.n for r in df.where("n = 10").select(T.within_cap("n", 10).alias("n")).collect()] == [10]
    with pytest.raises(Exception, match="token cap exceeded"):
        df.select(T.within_cap("n", 10).alias("n")).collect()
    with pytest.raises(Exception, match="system prompt not found"):
        df.select(T.system_prompt(F.lit(None).cast("string"), F.lit("x"))).collect()
    assert documents.indented_json('{"b":1,"a":[]}') == '{\n  "b": 1,\n  "a": []\n}' and documents.indented_json("{") is None and documents.indented_json(None) is None


def test_files_and_campaigns(spark, tmp_path):
    for slug in ("zeta", "alpha", "demo"):
        (tmp_path / slug).mkdir()
        (tmp_path / slug / "MISSION.md").write_text("m")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.md").write_text("x")
    (tmp_path / "alpha" / "p.JPG").write_bytes(b"\xff\xd8")
    (tmp_path / "alpha" / "book.md").write_text("full" * 10)
    (tmp_path / "alpha" / "book.digest.md").write_text("short")
    found = readers.files(spark, str(tmp_path))
    assert [r.slug for r in readers.campaigns(found, "demo").collect()] == ["demo", "alpha", "zeta"]
    images = {r.path.rsplit("/", 1)[1]: r for r in readers.images(found).collect()}
    assert images["p.JPG"].url == "data:image/jpeg;base64,/9g=" and images["book.md"].error
    listed = readers.source_list(found.where("name LIKE 'book%'"), found).collect()
    assert [(r.kind, r.name, r.has_digest, r.digest_tokens_est) for r in listed] == [("rules", "book.md", True, 1), ("reference", "p.JPG", False, None)]
    digested = documents.prefer_digest(readers.documents(spark, str(tmp_path / "alpha"), "book*.md")).collect()
    assert [(r.book, r.name, r.text) for r in digested] == [("book.md", "book.digest.md", "short")]
    assert "### rules/book.digest.md\n\nshort\n" in documents.project_context("m", "{}", None, readers.documents(spark, str(tmp_path / "alpha"), "book*.md")).first().context
    assert readers.read_json_document(spark, str(tmp_path / "nope.json"), 5) == 5 and readers.read_json_document(spark, str(tmp_path / "alpha" / "book.md"), {}) == {}
    assert readers.resolve_state_dir(spark, str(tmp_path / "gone"), "alpha", str(tmp_path), "x") is None
    assert readers.resolve_state_dir(spark, None, "alpha", str(tmp_path), "x").endswith("alpha")


def test_sheets(spark):
    cells = [("b.xlsx", 0, "s", 0, ["a", None]), ("b.xlsx", 0, "s", 1, ["1"]), ("b.xlsx", 0, "s", 2, ["1", "2", "3"]), ("b.xlsx", 1, "e", None, None)]
    df = spark.createDataFrame(cells, "workbook string, sheet_no int, sheet string, row_no int, cells array<string>")
    assert readers.sheet_markdown(df).first().markdown == "### b.xlsx\n\n#### sheet: s\n\n| a |  |\n|---|---|\n| 1 |  |\n| 1 | 2 |\n\n#### sheet: e\n\n_(empty)_"


def test_injected_models(spark):
    def model(text):
        if "bad" in text:
            raise ValueError("no")
        return {"text": "Q: a question that is long enough\nnoise\nQ. another question, long enough too\nQ: short"}

    tasks = distill.expansion_tasks(distill.seed_rows(spark, {"t": ["s1", "bad"], "u": ["s2"]}), spark.createDataFrame([("d1",), ("d2",)], "domain string"))
    assert tasks.count() == 6
    got = distill.expand(tasks, model, F.concat_ws(" ", "seed", "domain"), most=2)
    assert got.count() == 8 and set(got.columns) == {"template", "seed_idx", "seed", "domain", "query"}

    def teacher(query):
        return {"response": "trade scope " * 20 if "another" in query else "short", "cost_usd": 0.25, "latency_ms": 3}

    report = distill.generation_report(distill.generate(got, teacher)).first()
    assert (report.written, report.skipped, report.cost_usd) == (4, 4, 1.0)
    kept, bad = sinks.quarantine(spark.createDataFrame([("b", "[backend=x]")], "stdout string, stderr string").withColumn("checked", __import__("calltide.functions.text", fromlist=["x"]).validated("stdout", "stderr")))
    assert kept.count() == 0 and bad.first().text.startswith("# error: missing")


def test_evaluation(spark):
    text = {0: "", 1: "trade", 3: "trade scope structural", 5: "trade scope structural verification load-bearing"}
    rows = spark.createDataFrame([(k, k == 3, (t,), (None,) if k else ("trade",)) for k, t in text.items()], "idx int, is_forgetting boolean, gold struct<response string>, student struct<response string>")
    long = evaluate.long_form(rows, ("gold", "student"))
    got = {r.condition: (r.mean_score, r.n) for r in evaluate.condition_means(long, ["condition"]).collect()}
    assert got == {"gold": ((0 + 0.25 + 0.75 + 1) / 4, 4), "student": (0.25, 1)}
    variants = long.withColumn("variant", F.when(F.col("idx") < 3, "v1").otherwise("v2"))
    pivot = {r.condition: (r.v1, r.v2, r.v2_delta) for r in evaluate.condition_pivot(variants, ["v1", "v2"]).collect()}
    assert pivot == {"gold": (0.5, 4.0, 3.5), "student": (1.0, 0.0, -1.0), "ablation": (0.0, 0.0, 0.0), "vanilla": (0.0, 0.0, 0.0)}
    for delta, want in ((0.5, "LAUNCH SWAP"), (0.2, "POST-LAUNCH FOLLOW-UP"), (0.1, "NO-GO"), (-0.1, "NO-GO"), (-0.2, "REVERT")):
        one = evaluate.best_variant(spark.createDataFrame([(0, "a", delta), (1, "b", delta)], "position int, variant string, delta double")).first()
        assert (one.winner, one.decision) == ("a", want)
    means = spark.createDataFrame([("student", 0.9), ("gold", 1.0), ("ablation", 0.8)], "condition string, mean_score double")
    assert evaluate.score_verdict(means).first()[-2:] == ("PASS", "ADAPTER WINS")
    assert evaluate.score_verdict(means.where("condition = 'gold'")).first().ratio_verdict is None


def test_judging(spark):
    outcomes = ["candidate_wins"] * 27 + ["baseline_wins"] * 13
    one = evaluate.outcome_summary(spark.createDataFrame([(o,) for o in outcomes], "outcome string")).first()
    assert (one.n, one.win_rate, one.preferred) == (40, 0.675, "candidate")
    assert evaluate.outcome_summary(spark.createDataFrame([], "outcome string")).first().win_rate == 0.0
    slots = {r.idx: r.candidate_slot for r in evaluate.with_slots(spark.range(50).withColumnRenamed("id", "idx")).collect()}
    assert slots == {i: "A" if random.Random(i).random() < 0.5 else "B" for i in range(50)}
    assert evaluate.precision(spark.createDataFrame([("x",)] * 9 + [(" ",)] * 8, "box string")).first().verdict == "FAIL"
    assert evaluate.precision(spark.createDataFrame([], "box string")).first().verdict == "NO BOXES"
    a = spark.createDataFrame([(0, "q", False, "r"), (1, "q", True, "r"), (2, "q", None, "")], "idx int, query string, is_forgetting boolean, response string")
    assert [r.idx for r in evaluate.judged_pairs(a, a).collect()] == [0]


def test_documents(spark):
    block = "**----- Start of picture text -----**<br>\n{}<br>**----- End of picture text -----**<br>\n"
    md = "\n".join(["# Rules", block.format("6.1 Moving"), block.format("6.1.2 Roads"), block.format("7.0 Combat"), block.format("just text"), "ACME GAMES", "keep", "ACME GAMES", "Page 7", "12", "ACME GAMES", "1234", "**==> picture [1 x 2] intentionally omitted <==**", "ACME GAMES", *["- item"] * 5, *["thrice"] * 3, "x" * 61, "x" * 61, "x" * 61, "x" * 61, "", "", "", "", "end", ""])
    got = spark.createDataFrame([(md,)], "md string").select(documents.clean_markdown("md").alias("r")).first().r
    assert got.startswith("# Rules\n### 6.1 Moving\n") and "#### 6.1.2 Roads\n" in got and "## 7.0 Combat\n" in got and "**just text**" in got
    sections = ("6.1a Movement", "10.5a Note", "1.2.3a", "12a", "1.2.3.4.5 Deep", "1.10a Foo")
    shown = spark.createDataFrame([("x" + "".join(block.format(x) for x in sections),)], "md string").select(documents.promote_picture_text("md").alias("r")).first().r
    assert shown == "x### 6.1a Movement\n\n### 10.5a Note\n\n### 1.2.3a\n\n**12a**\n\n### 1.2.3.4.5 Deep\n\n### 1.10a Foo\n\n"
    assert "ACME" not in got and "Page 7" not in got and "\n12\n" not in got and "1234" in got and "omitted" not in got
    assert got.count("- item") == 5 and got.count("thrice") == 3 and got.count("x" * 61) == 4 and "\n\n\n" not in got and got.endswith("end\n")
    log = "# Log\n\n" + "".join(f"## Turn {k}\ntext {k}\n\n" for k in (5, 4, 3, 2, 1))
    cut = spark.createDataFrame([(log,), ("## Turn 1\nx",)], "t string").select(documents.trim_turns("t", 2).alias("r")).collect()
    assert cut[0].r.startswith("# Log\n\n## Turn 5\ntext 5\n\n## Turn 4\ntext 4\n\n---") and "_(3 earlier turn(s) omitted" in cut[0].r and cut[1].r == "## Turn 1\nx"


ORDERS = """intro is dropped
## What I see on the board
- red tank
  near the hill
* blue unit

## UNREAD
some  hex
numbers
## Situation
First para
goes on.

Second para.
## Intent
Hold.
## Reserves & Fallback
Last words.
— Acknowledged. Moving out.
"""


def test_orders(spark):
    rows = spark.createDataFrame([(0, ORDERS), (1, ORDERS + "## Acknowledged\n— Acknowledged.  By HQ\n"), (2, "no headers"), (3, "## Intent\n— Acknowledged."), (4, "## Intent\nold\n## intent\nnew"), (5, "## What I see on the board\nplain\nlines")], "id int, md string")
    got = {r.id: r.orders for r in orders.parse(rows).collect()}
    assert got[0].see_board == ["red tank near the hill", "blue unit"] and got[0].unread == "some hex numbers"
    assert [(s.n, s.title, s.body) for s in got[0].sections] == [("01", "Situation", ["First para goes on.", "Second para."]), ("02", "Intent", ["Hold."]), ("05", "Reserves & Fallback", ["Last words."])]
    assert got[0].ack == "— Acknowledged. Moving out." and got[1].ack == "— Acknowledged. By HQ" and got[1].sections[2].body == ["Last words. — Acknowledged. Moving out."]
    assert got[2].sections == [] and got[2].see_board == [] and got[2].unread == orders.UNREAD and got[2].ack == orders.ACKNOWLEDGED
    assert got[3].ack == "— Acknowledged." and got[3].sections[0].body == [] and got[4].sections[0].body == ["new"] and got[5].see_board == ["plain lines"]
    assert {r.id: r.i for r in orders.parse(rows).select("id", orders.intent().alias("i")).collect()}[0] == "Hold."


def test_campaigns(spark):
    c = spark.createDataFrame([("red-wave", None, None, 1.0, None, None)], "slug string, name string, started string, spend double, spend_budget double, model string")
    turns = spark.createDataFrame([("red-wave", 1, "a/m1", True), ("red-wave", 2, "a/m2", True)], "slug string, turn int, model string, current boolean")
    one = campaign.summary(c, turns, 25.0, "x/default").first()
    assert (one.name, one.spend_budget, one.model, one.turn) == ("Red Wave", 25.0, "x/default", 2)
    issued = campaign.issue_turn(turns, spark.createDataFrame([("red-wave", None, "b/m3")], "slug string, turn int, model string")).orderBy("turn").collect()
    assert [(r.turn, r.current) for r in issued] == [(1, False), (2, False), (3, True)] and issued[2].model == "m3"
    assert campaign.add_spend(c, spark.createDataFrame([("red-wave", 0.1), ("red-wave", None)], "slug string, cost_usd double")).first().spend == 1.1
    many = spark.createDataFrame([("red-wave", 0.0000004)] * 5 + [("red-wave", 0.0000016)], "slug string, cost_usd double")
    assert campaign.add_spend(c, many).first().spend == 1.000002  # each call is rounded to six places
    tasks = spark.createDataFrame([([("u1", 3)], [("u2", 4)])], "blue array<struct<name string, strength int>>, red array<struct<name string, strength int>>")
    assert [(r.side, r.name) for r in campaign.units(tasks).collect()] == [("blue", "u1"), ("red", "u2")]
    routed = {r.name: r.route for r in sinks.route_uploads(spark.createDataFrame([("a.PDF", 1), ("b.md", 1), ("c.png", 21 << 20), ("d.png", 1), ("e.zip", 1)], "name string, length long")).collect()}
    assert routed == {"a.PDF": "rules", "b.md": "rules", "c.png": "error", "d.png": "reference", "e.zip": "error"}
