"""Relevance of earlier calls to a query: overlap on rare tokens times linear recency decay, then a budgeted prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.text import STOP_WORDS, col, excerpt, token_estimate, tokens
from calltide.functions.values import age_days, int_ids, recency, shared_ids

MIN_SCORE = 4.0
TOP_K = 3
RARE_BELOW = 0.10
DECAY_DAYS = 30.0
PREAMBLE_TOKENS = 3500


def token_rows(entries: DataFrame, key: str, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(key, token), each distinct token of each entry once."""
    return entries.select(key, F.explode(tokens(text, stop_words)).alias("token"))


def document_frequency(entries: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(token, df): in how many entries a token occurs."""
    return entries.select(F.explode(tokens(text, stop_words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def rare_tokens(entries: DataFrame, text: str, below: float = RARE_BELOW, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(token, df) of the tokens in fewer than ``below`` of all entries, entries without tokens counted too."""
    total = entries.agg(F.count(F.lit(1)).alias("n"))
    return document_frequency(entries, text, stop_words).crossJoin(F.broadcast(total)).where(F.col("df") / F.col("n") < below).select("token", "df")


def overlaps(queries: DataFrame, entries: DataFrame, query_key: str, query_text: str, entry_key: str, entry_text: str, rare: DataFrame | None = None, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_key, entry_key, overlap) of pairs that share a (rare) token, by an inverted index: no pair without one is formed.

    Tokens of the queries prune the entries' tokens first, so what is shuffled are postings of tokens that are asked for.
    """
    asked = token_rows(queries, query_key, query_text, stop_words)
    if rare is not None:
        asked = asked.join(rare.select("token"), "token", "left_semi")
    return asked.join(token_rows(entries, entry_key, entry_text, stop_words), "token").groupBy(query_key, entry_key).agg(F.count(F.lit(1)).alias("overlap"))


def rank(queries: DataFrame, entries: DataFrame, query_key: str, query_text: str, entry_key: str, entry_text: str, age: Column, min_score: float = MIN_SCORE, top_k: int = TOP_K, rare_below: float = RARE_BELOW, stop_words: Sequence[str] = STOP_WORDS, decay_days: float = DECAY_DAYS) -> DataFrame:
    """(query_key, rank, entry_key, score): the best entries of each query; ties go to the smaller entry_key.

    ``age`` is a column over ``entries``: an entry's age in days. Scores are shared rare tokens times recency.
    """
    rare = rare_tokens(entries, entry_text, rare_below, stop_words)
    # an entry too old to score has no part in the join, and its recency travels with its key
    aged = entries.select(F.struct(F.col(entry_key).alias("key"), recency(age, decay_days).alias("recency")).alias("__entry"), entry_text)
    aged = aged.where("__entry.recency > 0") if min_score > 0 else aged
    pairs = overlaps(queries, aged, query_key, query_text, "__entry", entry_text, rare, stop_words)
    scored = pairs.select(query_key, F.col("__entry.key").alias(entry_key), (F.col("overlap") * F.col("__entry.recency")).alias("score"))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(entry_key))
    return scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(query_key, "rank", entry_key, "score")


def top_entries(entries: DataFrame, query: str, now: Column, text: str = "query", ts: str = "ts", seq: str = "seq", min_score: float = MIN_SCORE, top_k: int = TOP_K, rare_below: float = RARE_BELOW, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The entries most relevant to one query, best first, with ``score``; of equals the earlier seq. A query without tokens finds none."""
    rare = rare_tokens(entries, text, rare_below, stop_words)
    asked = entries.sparkSession.range(1).select(F.explode(tokens(F.lit(query), stop_words)).alias("token")).join(rare, "token", "left_semi")
    shared = token_rows(entries.withColumn("__seq", F.col(seq)), "__seq", text, stop_words).join(F.broadcast(asked), "token").groupBy("__seq").agg(F.count(F.lit(1)).alias("__overlap"))
    found = entries.join(shared, F.col(seq) == F.col("__seq")).withColumn("score", F.col("__overlap") * recency(age_days(now, ts))).drop("__seq", "__overlap")
    return found.where(F.col("score") >= min_score).orderBy(F.desc("score"), seq).limit(top_k)


def entry_text(new_ids: Sequence[int] | Column, timestamp: str = "timestamp", template: str = "template", query: str = "query", response: str = "response", ids: str = "retrieved_corpus_ids") -> Column:
    """How an earlier call is quoted in a preamble."""
    wanted = new_ids if isinstance(new_ids, Column) else F.array(*map(F.lit, new_ids)).cast("array<int>")
    matched = F.array_join(F.transform(shared_ids(int_ids(ids), wanted), lambda x: x.cast("string")), ", ")
    return F.concat(
        F.lit("### "), F.coalesce(timestamp, F.lit("?")), F.lit(" — template:"), F.coalesce(template, F.lit("?")), F.lit(" — shared corpus IDs: ["), matched, F.lit("]\n\n**Prior query:** "), excerpt(query, 400),
        F.lit("\n\n**Prior response (excerpt):** "), excerpt(response, 800), F.lit("\n\n"),
    )


def budget_prefix(rows: DataFrame, cost: Column | str, budget: Column | float, order: Sequence[Column | str], partition: Sequence[str] = ()) -> DataFrame:
    """The rows taken in order while their running cost stays within the budget; the first that breaks it ends the prefix.

    Costs are not negative, so a running sum is the same rule. Without ``partition`` all rows come into one task: limit
    them first, as a top-k does.
    """
    running = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return rows.withColumn("running_cost", F.sum(col(cost)).over(running)).where(F.col("running_cost") <= limit)


def preamble_budget(cap: int, overhead: Column | int) -> Column:
    return F.greatest(F.lit(0), F.lit(cap) - (overhead if isinstance(overhead, Column) else F.lit(overhead)))


def preamble(matches: DataFrame, new_ids: Sequence[int], order: str = "rank", state: str | None = None, max_tokens: int = PREAMBLE_TOKENS) -> DataFrame:
    """One row: the preamble of the matches that fit, and its token estimate; matches are at most a few (a top-k)."""
    quoted = matches.withColumn("__text", entry_text(new_ids)).withColumn("__cost", token_estimate("__text"))
    fits = budget_prefix(quoted, "__cost", max_tokens, [order])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__text"))), lambda x: x["__text"]), "\n")
    parts = fits.agg(body.alias("__body"), F.count(F.lit(1)).alias("matches"))
    section = F.when(F.col("matches") > 0, F.concat(F.lit("## Prior structurally-similar audits\n\n"), "__body"))
    text = F.concat_ws("\n", F.lit("# Preamble: structurally-similar prior context\n"), section, *([F.lit("## Active project context\n"), F.lit(state)] if state else []))
    return parts.select(text.alias("preamble"), "matches").withColumn("tokens", token_estimate("preamble"))


def id_overlap(entries: DataFrame, new_ids: Sequence[int], ids: str = "retrieved_corpus_ids") -> DataFrame:
    """The retired rule: entries sharing two ids or more, or one where none shares two."""
    n = entries.withColumn("shared", F.size(F.array_intersect(int_ids(ids), F.array(*map(F.lit, new_ids)).cast("array<int>"))))
    best = n.agg(F.coalesce(F.max("shared"), F.lit(0)).alias("__best"))
    return n.crossJoin(F.broadcast(best)).where(F.col("shared") >= F.least(F.greatest("__best", F.lit(1)), F.lit(2))).drop("__best")


def recent_queries(entries: DataFrame, template: str, n: int, skip_prefix: str = "contract pre-flight", exclude_timestamp: str | None = None) -> DataFrame:
    """The n latest calls of a template by timestamp text, without pre-flight calls; a missing timestamp is last."""
    q = F.coalesce(F.col("query"), F.lit(""))
    rows = entries.where((F.col("template") == template) & ~q.startswith(skip_prefix))
    if exclude_timestamp is not None:
        rows = rows.where(~F.col("timestamp").eqNullSafe(F.lit(exclude_timestamp)))
    return rows.orderBy(F.desc(F.coalesce("timestamp", F.lit(""))), "seq").limit(n)


