"""The call table: calls joined to their metrics, normalised, searched, sorted and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.text import strings, strip
from calltide.functions.values import first_truthy


def last_by_key(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One row per key (null is a key too): the one of largest seq."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("__last")).select(key, "__last.*")


def join_metrics(calls: DataFrame, metrics: DataFrame, key: str = "timestamp", seq: str = "seq") -> DataFrame:
    """Every call once with ``m``, the last metric row of its key; missing keys match missing keys.

    The metrics are combined per key before the join, so a key met often costs one row.
    """
    last = last_by_key(metrics, key, seq)
    right = last.select(F.col(key).alias("__key"), F.struct(*(c for c in last.columns if c != key)).alias("m"))
    return calls.join(right, calls[key].eqNullSafe(right["__key"]), "left").drop("__key")


def normalize(joined: DataFrame) -> DataFrame:
    """The call table's 21 columns and seq, from calls with a struct ``m`` of metrics.

    Zero tokens count as absent, zero cost does not; cost falls back from the call to the metric to the usage figure.
    A missing label, query or response is empty; one that the log has as null stays null (``nulls``, where the calls have
    it, lists those fields).
    """
    nulls = F.coalesce(F.col("nulls"), strings(())) if "nulls" in joined.columns else strings(())
    text = lambda c: F.coalesce(F.col(c), F.when(~F.array_contains(nulls, c), ""))
    vision = F.coalesce(F.col("mode") == "wargame-vision", F.lit(False))
    empty = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return joined.select(
        "seq", "timestamp", F.when(vision, "vision").otherwise("audit").alias("kind"), F.when(vision, text("model")).otherwise(text("template")).alias("label"),
        text("query").alias("query"), text("response").alias("response"),
        first_truthy(F.when(vision, F.col("preamble_text_tokens")).otherwise(F.col("preamble_tokens")), "m.preamble_tokens", default=0).alias("tokens"),
        F.coalesce("cost_usd", "m.cost_usd", "usage_cost").alias("cost_usd"), "latency_ms", "wrapper_elapsed_ms", F.col("m.conclusion_changed"), F.col("m.exit_code"), "template",
        empty(F.col("new_query_corpus_ids")).alias("new_query_corpus_ids"), empty(F.col("matched_prior_corpus_ids")).alias("matched_prior_corpus_ids"), "injected_prior_count", "model", "state_dir",
        none(F.col("images")).alias("images"), none(F.col("xlsx")).alias("xlsx"), F.col("m.image_count"), F.col("m.xlsx_count"),
    )


def load(calls: DataFrame, metrics: DataFrame) -> DataFrame:
    return normalize(join_metrics(calls, metrics))


def page(rows: DataFrame, limit: int = 100, offset: int = 0, seq: str = "seq") -> DataFrame:
    """Newest first, from ``offset`` on. Page the calls before joining metrics: the join adds no rows."""
    return rows.orderBy(F.desc(seq)).offset(max(0, offset)).limit(limit)


def load_page(calls: DataFrame, metrics: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the call table: the calls are cut to the page first, and only their metrics are looked up."""
    few = page(calls, limit, offset)
    near = metrics.join(F.broadcast(few.select(F.col("timestamp").alias("__t")).distinct()), metrics["timestamp"].eqNullSafe(F.col("__t")), "left_semi")
    return load(few, near).orderBy(F.desc("seq"))


def lookup(rows: DataFrame, key: object, on: str = "timestamp", seq: str = "seq") -> DataFrame:
    """The first row of the key (a value, or a column of ``rows``) by seq; no row where there is none."""
    return rows.where(F.col(on) == (key if isinstance(key, Column) else F.lit(key))).orderBy(seq).limit(1)


def search(rows: DataFrame, text: str, columns: tuple[str, ...] = ("query", "label", "response")) -> DataFrame:
    """Rows with the text in one of the columns, whatever its case; a blank text keeps every row."""
    if not text.strip():
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return rows.where(hit)


def sort(rows: DataFrame, by: str = "timestamp", descending: bool = True, ties: tuple[str, ...] = ("seq",)) -> DataFrame:
    """By one column, nulls last in both directions."""
    c = F.col(by)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def union_logs(*logs: DataFrame) -> DataFrame:
    """All rows of all logs, the first log's first: seq becomes (log, seq) in one number; missing columns are null."""
    out = None
    for k, log in enumerate(logs):
        one = log.withColumn("seq", F.struct(F.lit(k).alias("log"), F.col("seq").cast("long").alias("seq")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def display(rows: DataFrame, most: int = 80) -> DataFrame:
    """Query and response as the table shows them."""
    from calltide.functions.text import format_cost, format_latency, truncate

    return rows.select("*", truncate(strip("query"), most).alias("query_short"), format_cost("cost_usd").alias("cost"), format_latency("latency_ms").alias("latency"))


