"""Scores of evaluation runs: per-condition means, comparisons of variants, pairwise judging, precision of matches."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.text import SCORE_MARKERS, capped_score, judge_outcome, judge_verdict, marker_hits
from calltide.operators.intime import numbered

CONDITIONS = ("gold", "student", "ablation", "vanilla")


def long_form(rows: DataFrame, conditions: Sequence[str] = CONDITIONS, keys: Sequence[str] = ("idx", "is_forgetting")) -> DataFrame:
    """(keys, condition, response) of every condition that has a response: one row scan, no join."""
    pairs = F.array(*(F.struct(F.lit(c).alias("condition"), F.col(f"{c}.response").alias("response")) for c in conditions))
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where(F.col("response").isNotNull())


def kind(is_forgetting: Column) -> Column:
    return F.when(F.coalesce(is_forgetting, F.lit(False)), "forgetting").otherwise("strategic")


def condition_means(responses: DataFrame, by: Sequence[str], text: str = "response", markers: Sequence[str] = SCORE_MARKERS) -> DataFrame:
    """(by, mean_score, mean_hits, n) of responses; sums of quarters and counts, so the means are exact."""
    return responses.groupBy(*by).agg(
        (F.sum(capped_score(text, markers)) / F.count(F.lit(1))).alias("mean_score"), (F.sum(marker_hits(text, markers)) / F.count(F.lit(1))).alias("mean_hits"), F.count(F.lit(1)).alias("n")
    )


def condition_cube(responses: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], total_over: str, text: str = "response", markers: Sequence[str] = SCORE_MARKERS) -> DataFrame:
    """(dims, level, mean_score, mean_hits, n, delta): means of all grouping sets in one pass over the responses.

    ``level`` is the grouping id: a bit for each of ``dims`` that the row sums over, the last one lowest, which tells a total
    from a group of null. ``delta`` is the mean score less that of the total over ``total_over``, where that set is asked for.
    """
    grouped = responses.groupingSets([[F.col(c) for c in own] for own in sets], *dims)
    score, hits, n = F.sum(capped_score(text, markers)), F.sum(marker_hits(text, markers)), F.count(F.lit(1))
    cells = grouped.agg(F.grouping_id().alias("level"), (score / n).alias("mean_score"), (hits / n).alias("mean_hits"), n.alias("n"))
    bit = 1 << (len(dims) - 1 - list(dims).index(total_over))
    key = F.struct(F.col("level").bitwiseOR(F.lit(bit)).alias("level"), *(F.col(c) for c in dims if c != total_over)).alias("__of")
    totals = cells.where(F.col("level").bitwiseAND(F.lit(bit)) != 0).select(key, F.col("mean_score").alias("__total"))
    return cells.withColumn("__of", key).join(totals, "__of", "left").select(*dims, "level", "mean_score", "mean_hits", "n", (F.col("mean_score") - F.col("__total")).alias("delta"))


def condition_pivot(responses: DataFrame, variants: Sequence[str], conditions: Sequence[str] = CONDITIONS, text: str = "response", markers: Sequence[str] = SCORE_MARKERS) -> DataFrame:
    """One row per condition in the given order: mean hits of each variant (0 of none) and its difference to the first."""
    hits = marker_hits(text, markers)
    mean = lambda v: F.coalesce(F.try_divide(F.sum(F.when(F.col("variant") == v, hits)), F.count_if(F.col("variant") == v)), F.lit(0.0)).alias(v)
    means = responses.groupBy("condition").agg(*map(mean, variants))
    order = responses.sparkSession.createDataFrame([(k, c) for k, c in enumerate(conditions)], "position int, condition string")
    full = F.broadcast(order).join(means, "condition", "left").na.fill(0.0, list(variants))
    return full.select("position", "condition", *variants, *((F.col(v) - F.col(variants[0])).alias(f"{v}_delta") for v in variants[1:]))


def adapter_signal(pivot: DataFrame, variants: Sequence[str], student: str = "student", ablation: str = "ablation") -> DataFrame:
    """One row per variant: mean hits of student less ablation, and that difference less the first variant's."""
    one = pivot.agg(*((F.sum(F.when(F.col("condition") == student, F.col(v)).when(F.col("condition") == ablation, -F.col(v)).otherwise(0.0))).alias(v) for v in variants))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("signal"), (F.col(v) - F.col(variants[0])).alias("versus_first")) for v in variants))).alias("s"))
    return rows.select("s.*")


def score_verdict(means: DataFrame, pass_ratio: float = 0.80, tie: float = 0.05) -> DataFrame:
    """One row from (condition, mean_score): student over gold with PASS or FAIL, and who wins of student and ablation; null without both sides."""
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("mean_score")))
    one = means.agg(of("student").alias("student"), of("gold").alias("gold"), of("ablation").alias("ablation"))
    both = F.col("student").isNotNull() & F.col("gold").isNotNull()
    ratio = F.when(both, F.when(F.col("gold") > 0, F.col("student") / F.col("gold")).otherwise(0.0))
    diff = F.col("student") - F.col("ablation")
    out = one.withColumn("ratio", ratio).withColumn("ratio_verdict", F.when(F.col("ratio") >= pass_ratio, "PASS").when(F.col("ratio").isNotNull(), "FAIL"))
    return out.withColumn("adapter_verdict", F.when(F.abs(diff) < tie, "NEAR TIE").when(diff > 0, "ADAPTER WINS").when(diff.isNotNull(), "PROMPT WINS"))


def best_variant(deltas: DataFrame, swap: float = 0.5, follow_up: float = 0.1) -> DataFrame:
    """One row from (position, variant, delta): the largest delta (of equals the first) and what follows from it."""
    best = deltas.agg(F.max_by(F.struct("variant", "delta"), F.struct("delta", -F.col("position"))).alias("b")).select(F.col("b.variant").alias("winner"), F.col("b.delta").alias("delta"))
    d = F.col("delta")
    return best.withColumn("decision", F.when(d >= swap, "LAUNCH SWAP").when(d > follow_up, "POST-LAUNCH FOLLOW-UP").when(F.abs(d) <= follow_up, "NO-GO").otherwise("REVERT"))


def attribution(first: Column, second: Column, near: float = 0.2) -> Column:
    """Which of two changes explains more: equal within ``near``, else the larger."""
    return F.when(F.abs(first - second) <= near, "equal").when(first > second, "first").otherwise("second")


def with_index(rows: DataFrame, order: Sequence[Column | str], partition: Sequence[str] = ()) -> DataFrame:
    """``idx`` from 0 in order within each partition, or over all rows."""
    if not partition:
        return numbered(rows, order)
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def zip_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """Rows of equal index side by side, ending with the shorter table."""
    return left.join(right, list(keys))


def judged_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, query, response_a, response_b) where neither side is a forgetting check and both answered; of (idx, query, is_forgetting, response)."""
    x, y = a.alias("x"), b.alias("y")
    plain = ~F.coalesce(F.col("x.is_forgetting"), F.lit(False)) & ~F.coalesce(F.col("y.is_forgetting"), F.lit(False))
    answered = (F.col("x.response") != "") & (F.col("y.response") != "")
    return x.join(y, "idx").where(plain & answered).select("idx", F.col("x.query").alias("query"), F.col("x.response").alias("response_a"), F.col("y.response").alias("response_b"))


def swap_slots(indices: Sequence[int]) -> list[tuple[int, str]]:
    """The slot of the candidate for each prompt index: a fair coin seeded by the index, so that judging is blind and repeatable."""
    return [(i, "A" if random.Random(i).random() < 0.5 else "B") for i in indices]


def with_slots(pairs: DataFrame, idx: str = "idx") -> DataFrame:
    """``candidate_slot`` by the seeded coin of swap_slots; the generator is not Spark's, so a batched function looks it up."""

    def slot(values: pd.Series) -> pd.Series:
        return pd.Series([s for _, s in swap_slots([int(v) for v in values])], dtype="object")

    return pairs.withColumn("candidate_slot", F.pandas_udf(slot, "string")(F.col(idx).cast("long")))


def judge(pairs: DataFrame, raw: str = "raw_judge", slot: str = "candidate_slot", candidate: str = "candidate", baseline: str = "baseline") -> DataFrame:
    """Add verdict and outcome to judged pairs."""
    return pairs.withColumn("verdict", judge_verdict(raw)).withColumn("outcome", judge_outcome("verdict", slot, candidate, baseline))


def outcome_summary(judged: DataFrame, candidate: str = "candidate", baseline: str = "baseline", preferred_above: float = 0.55) -> DataFrame:
    """One row: n, outcomes, the candidate's win rate without ties and unclear ones, and the preference."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    one = judged.agg(F.count(F.lit(1)).alias("n"), count(f"{candidate}_wins").alias("candidate_wins"), count(f"{baseline}_wins").alias("baseline_wins"), count("tie").alias("ties"), count("unclear").alias("unclear"))
    decided = F.greatest(F.col("n") - F.col("ties") - F.col("unclear"), F.lit(1))
    rate = F.col("candidate_wins") / decided
    word = F.when(rate > preferred_above, candidate).when(F.col("baseline_wins") / decided > preferred_above, baseline).otherwise("equal")
    return one.withColumn("win_rate", rate).withColumn("preferred", word)


def histogram(rows: DataFrame, column: str = "outcome") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def precision(boxes: DataFrame, box: str = "box", least: float = 0.60) -> DataFrame:
    """One row from checkbox marks: total, relevant, precision (null of none) and the verdict."""
    one = boxes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower(F.col(box)) == "x").alias("relevant"))
    out = one.withColumn("precision", F.try_divide("relevant", "total"))
    return out.withColumn("verdict", F.when(F.col("total") == 0, "NO BOXES").when(F.col("precision") >= least, "PASS").otherwise("FAIL"))


def results_by_prompt(prompts: DataFrame, results: DataFrame, key: str = "idx") -> DataFrame:
    """Every prompt with its results, null where it has none."""
    return prompts.join(results, key, "left")


def results_json(prompts: DataFrame, results: DataFrame, key: str = "idx") -> DataFrame:
    """(key, row) of every prompt: its result as JSON, {} where it has none, as a run that ended early leaves it."""
    own = results.select(key, F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("row"))
    return prompts.select(key).join(own, key, "left").select(key, F.coalesce("row", F.lit("{}")).alias("row"))


def markdown_table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """A Markdown table of a few collected rows, columns padded to their widest cell."""
    width = [max(len(str(r[k])) for r in [head, *rows]) for k in range(len(head))]
    line = lambda r: "| " + " | ".join(str(c).ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows)])
