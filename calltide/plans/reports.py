"""Reports of a few rows each, made on the driver from frames that operators have reduced to that."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.text import one_line
from calltide.operators.evaluate import CONDITIONS, markdown_table
from calltide.operators.relevance import rank
from calltide.sources.sinks import write_text


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def evaluation_summary(means: DataFrame, verdict: DataFrame, date: str) -> str:
    """Markdown of (kind, condition, mean_score, n) and one row of score_verdict; conditions without answers are left out."""
    rows = {(r.kind, r.condition): r for r in means.collect()}
    out = [f"# Evaluation — {date}"]
    for kind, title in (("strategic", "Strategic prompts (higher is better)"), ("forgetting", "Forgetting checks (lower is better)")):
        own = [rows[kind, c] for c in CONDITIONS if (kind, c) in rows]
        if own:
            out += ["", f"## {title}", "", markdown_table(["Condition", "Mean score", "n"], [[r.condition, f"{r.mean_score:.3f}", str(r.n)] for r in own])]
    one = verdict.first()
    out += ["", "## Verdicts", ""]
    if one.ratio is not None:
        out.append(f"- student/gold: {one.ratio:.2f}, {one.ratio_verdict}")
    if one.adapter_verdict is not None:
        out.append(f"- student against ablation: {one.adapter_verdict} ({one.student - one.ablation:+.3f})")
    return "\n".join(out) + "\n"


def comparison(pivot: DataFrame, signal: DataFrame, best: DataFrame, variants: list[str]) -> str:
    """Markdown of mean marker counts by condition and variant, the adapter signal and the decision."""
    first, others = variants[0], variants[1:]
    rows = [[r.condition, *(f"{r[v]:.2f}" for v in variants), *(f"{r[f'{v}_delta']:+.2f}" for v in others)] for r in pivot.orderBy("position").collect()]
    out = ["# Comparison", "", markdown_table(["Condition", *variants, *(f"{v}-{first}" for v in others)], rows), "", "## Adapter signal", ""]
    out += [f"- {r.variant}: {r.signal:+.2f} ({r.versus_first:+.2f} against {first})" for r in signal.collect()]
    one = best.first()
    return "\n".join([*out, "", "## Decision", "", f"{one.decision}: {one.winner} with {one.delta:+.2f}"]) + "\n"


def judge_details(judged: DataFrame) -> DataFrame:
    """Every judged pair as the report lists it; to be written as JSON lines where there are more than a few."""
    return judged.select("idx", F.substring("query", 1, 80).alias("query"), "candidate_slot", "raw_judge", "verdict", "outcome")


def judge_report(summary: DataFrame, judged: DataFrame) -> dict:
    """The JSON report of a judging of a few pairs: outcomes, n, win rate and every pair by index."""
    one = summary.first()
    counts = {"candidate_wins": one.candidate_wins, "baseline_wins": one.baseline_wins, "tie": one.ties, "unclear": one.unclear}
    details = judge_details(judged).orderBy("idx").collect()
    return {"outcomes": {k: n for k, n in counts.items() if n}, "n": one.n, "win_rate_without_ties": one.win_rate, "details": [r.asDict() for r in details]}


def score_sheet(targets: DataFrame, entries: DataFrame, age, **options) -> str:
    """Markdown with a box to tick for every match of every target (idx, query), for precision to be counted from."""
    found = rank(targets, entries, "idx", "query", "seq", "query", age, **options).join(entries.select("seq", one_line("query", 150).alias("match")), "seq")
    by_target: dict[int, list] = {}
    for r in found.orderBy("idx", "rank").collect():
        by_target.setdefault(r.idx, []).append(r)
    out = ["# Precision sheet", ""]
    for t in targets.select("idx", one_line("query", 200).alias("query")).orderBy("idx").collect():
        out += [f"## Query {t.idx + 1}", "", f"> {t.query}", ""]
        out += [f"- [ ] **match {t.idx + 1}.{r['rank']}** score {r.score:.2f}: {r.match}" for r in by_target.get(t.idx, [])] or ["_(no matches)_"]
        out.append("")
    return "\n".join(out)


def score_sheet_rows(targets: DataFrame, entries: DataFrame, age, **options) -> DataFrame:
    """(idx, section) for every target (idx, query): its part of the sheet; a target's matches are at most a top-k."""
    found = rank(targets, entries, "idx", "query", "seq", "query", age, **options).join(entries.select("seq", one_line("query", 150).alias("match")), "seq")
    box = F.format_string("- [ ] **match %d.%d** score %.2f: %s", F.col("idx") + 1, "rank", "score", "match")
    listed = found.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", box.alias("box")))), lambda x: x["box"]), "\n").alias("boxes"))
    head = F.concat(F.lit("## Query "), (F.col("idx") + 1).cast("string"), F.lit("\n\n> "), one_line("query", 200), F.lit("\n\n"))
    return targets.join(listed, "idx", "left").select("idx", F.concat(head, F.coalesce("boxes", F.lit("_(no matches)_")), F.lit("\n")).alias("section"))


def missing_files(expected: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """The expected names that are not there; a publishing step stops at any."""
    return expected.join(present.select(key), key, "left_anti")
