"""Training data: seed expansion, generation with quality filters, chat formatting, mixing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.text import messages, passes_anti_leakage, passes_quality, question_lines
from calltide.functions.values import exact_sum
from calltide.operators.intime import numbered
from calltide.sources.readers import call_model


#: Domains up to which they are broadcast.
MOST_DOMAINS = 10_000


def seed_rows(spark: SparkSession, seeds: Mapping[str, Sequence[str]], group: str = "template") -> DataFrame:
    """(group, seed_idx, seed) of a mapping of lists, in its order."""
    rows = [(g, k, s) for g, own in seeds.items() for k, s in enumerate(own)]
    return spark.createDataFrame(rows, f"{group} string, seed_idx int, seed string")


def seed_totals(seeds: DataFrame, group: str = "template") -> DataFrame:
    """(group, seeds) of a table with an array of seeds per group, and the total in a row of null group."""
    return seeds.rollup(group).agg(F.sum(F.size("seeds")).cast("long").alias("seeds"))


def expansion_tasks(seeds: DataFrame, domains: DataFrame) -> DataFrame:
    """Every seed with every domain; domains are a short list, which is counted before it is broadcast."""
    short = domains.limit(MOST_DOMAINS + 1).count() <= MOST_DOMAINS
    return seeds.crossJoin(F.broadcast(domains) if short else domains)


def expand(tasks: DataFrame, model: Callable[[str], dict], prompt: Column, most: int, more_than: int = 20, less_than: int | None = None) -> DataFrame:
    """One row per question that the model's text has for a task; ``model`` takes the prompt and returns {"text": …}."""
    called = call_model(tasks.withColumn("prompt", prompt), "prompt", model, "text string")
    return called.withColumn("query", F.explode(question_lines("text", more_than, less_than, most))).drop("text", "error", "prompt")


def generate(expansions: DataFrame, teacher: Callable[[str], dict], on_domain: bool = True) -> DataFrame:
    """Each query with the teacher's response, cost and latency and ``keep``: no error and the filter of its kind passed."""
    called = call_model(expansions, "query", teacher, "response string, cost_usd double, latency_ms long")
    good = passes_quality("response") if on_domain else passes_anti_leakage("response")
    return called.withColumn("keep", F.col("error").isNull() & F.coalesce(good, F.lit(False)))


def generation_report(generated: DataFrame, *by: str) -> DataFrame:
    """written, skipped and the cost of what was written, in one row or one per group."""
    cost = F.coalesce(exact_sum(F.when(F.col("keep"), F.coalesce("cost_usd", F.lit(0.0)))), F.lit(0.0))
    return generated.groupBy(*by).agg(F.count_if("keep").alias("written"), F.count_if(~F.col("keep")).alias("skipped"), cost.alias("cost_usd"))


def chat_examples(pairs: DataFrame, query: str = "query", response: str = "response") -> DataFrame:
    """``messages``: the query as the user's and the response as the assistant's, no system message."""
    return pairs.select(messages(query, response).alias("messages"))


def seed_table(groups: DataFrame, group: str = "template", seeds: str = "seeds") -> DataFrame:
    """(group, seed_idx, seed) of a table with an array of seeds per group, in the array's order."""
    return groups.select(group, F.posexplode(seeds).alias("seed_idx", "seed"))


def mix_order(key: str, seed: int = 42) -> list[Column]:
    """An order that looks random and depends on key and seed only; equal keys stand together."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).asc_nulls_first(), F.col(key).asc_nulls_first()]


def mix(*parts: DataFrame, key: str = "query", seed: int = 42) -> DataFrame:
    """All pairs of all parts in an order that looks random and is the same for the same rows and seed."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(*mix_order(key, seed))


def mixed(*parts: DataFrame, key: str = "query", seed: int = 42) -> DataFrame:
    """The rows of ``mix`` with their ``place`` in it, from 0."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return numbered(out, mix_order(key, seed), "place")


def tagged_union(strategic: DataFrame, forgetting: DataFrame, limit: int = 0) -> DataFrame:
    """Evaluation prompts and then forgetting checks with is_forgetting; a limit (0: none) counts before the union."""
    first = strategic.orderBy("idx").limit(limit) if limit else strategic
    return first.withColumn("is_forgetting", F.lit(False)).unionByName(forgetting.withColumn("is_forgetting", F.lit(True)), allowMissingColumns=True)
