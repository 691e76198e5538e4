"""An inverted index over entries for relevance search, which grows by segments and skips what cannot score.

``append`` writes one segment: the entries with their token sets, postings in blocks (one token, a stretch of time, at most
about ``BLOCK`` entries), and how many entries each token has. No earlier segment is touched, and one that was not written to
its end is not read. Which tokens are rare follows at search time from the counts of all segments.

``search`` gives the results of ``relevance.rank``. An entry's score is its shared rare tokens times its recency, so at least
m = min_score / (best recency) of a query's q rare tokens must be shared: whoever shares m has one of the q - m + 1 rarest,
and only their postings are read, never those of more frequent tokens. A block is skipped where q times the recency of its
newest entry is below what a result needs, which is min_score at first and, once newer blocks have been searched, the
query's k-th best score so far. Candidates are scored on their token sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltide.functions.text import STOP_WORDS, tokens
from calltide.functions.values import age_days, recency
from calltide.operators.relevance import DECAY_DAYS, MIN_SCORE, RARE_BELOW, TOP_K, token_rows
from calltide.sources.scratch import finished, subfolders, written

BLOCK = 512
#: Days of a block's stretch of time.
STRETCH_DAYS = 1
#: Rounds of a search: blocks whose newest entry has at least so large a share of the best recency; the rest comes last.
ROUNDS = (0.75, 0.5, 0.0)
#: Candidate pairs up to which they are broadcast to the token sets (some 40 bytes each).
BROADCAST_ROWS = 500_000


def append(entries: DataFrame, path: str, key: str, text: str, time: str, stop_words: Sequence[str] = STOP_WORDS, block: int = BLOCK) -> str:
    """Index ``entries`` as one more segment at ``path``; its name. Entries without key or time are found as such; repeated ones count each."""
    spark = entries.sparkSession
    name = f"segment-{len(subfolders(spark, path)):08d}-{uuid.uuid4().hex}"
    at = f"{path.rstrip('/')}/{name}"
    rows = entries.select(F.struct(F.lit(name).alias("segment"), F.monotonically_increasing_id().alias("n")).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").alias("time"), tokens(F.col(f"`{text}`"), stop_words).alias("tokens"))
    rows.write.parquet(f"{at}/entries")
    held = spark.read.parquet(f"{at}/entries")
    stretch = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / (STRETCH_DAYS * 86_400_000_000)).alias("stretch")
    each = held.select(F.explode("tokens").alias("token"), stretch, "row", "time")
    # a token that many entries of one stretch hold is cut into parts, so that no group grows with the log
    sized = each.groupBy("token", "stretch").agg(F.count(F.lit(1)).alias("n"))
    cut = sized.select(F.col("token").alias("t"), F.col("stretch").alias("s"), F.ceil(F.col("n") / block).alias("parts"))
    placed = each.join(cut, (F.col("token") == F.col("t")) & F.col("stretch").eqNullSafe(F.col("s"))).select("token", "stretch", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), "row", "time")
    blocks = placed.groupBy("token", "stretch", "part").agg(F.max("time").alias("newest"), F.collect_list(F.struct("row", "time")).alias("entries"))
    blocks.select("token", "newest", "entries").repartitionByRange("token").sortWithinPartitions("token", F.desc("newest")).write.parquet(f"{at}/blocks")
    counts = sized.groupBy("token").agg(F.sum("n").alias("n"))
    # the counts are written last: a segment without them is not there
    counts.unionByName(held.agg(F.lit(None).cast("string").alias("token"), F.count(F.lit(1)).alias("n"))).write.parquet(f"{at}/counts")
    return name


def segments(spark: SparkSession, path: str) -> list[str]:
    """The paths of the segments that were written to their end."""
    return [at for at in (f"{path.rstrip('/')}/{name}" for name in subfolders(spark, path)) if finished(spark, f"{at}/counts")]


def _asked(spark: SparkSession, found: list[str], queries: DataFrame, query_key: str, query_text: str, rare_below: float, stop_words: Sequence[str]) -> DataFrame:
    """(query, token, df) of the queries' rare tokens."""
    counts = spark.read.parquet(*(f"{at}/counts" for at in found))
    total = counts.where("token IS NULL").agg(F.sum("n").alias("entries"))
    wanted = token_rows(queries.select(F.col(f"`{query_key}`").alias("query"), F.col(f"`{query_text}`").alias("__text")), "query", "__text", stop_words)
    df = counts.where("token IS NOT NULL").join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
    rare = df.crossJoin(F.broadcast(total)).where(F.col("df") / F.col("entries") < rare_below)
    return wanted.join(rare.select("token", "df"), "token").select("query", "token", "df")


def essential(asked: DataFrame, least: int) -> DataFrame:
    """(query, token, q) of the q - least + 1 rarest tokens of each query; a query of fewer than ``least`` has none."""
    order = Window.partitionBy("query").orderBy("df", "token")
    ranked = asked.withColumns({"place": F.row_number().over(order), "q": F.count(F.lit(1)).over(Window.partitionBy("query"))})
    return ranked.where(F.col("place") <= F.col("q") - least + 1).select("query", "token", "q")


def read_blocks(blocks: DataFrame, wanted: DataFrame, now: Column, floors: DataFrame | None, min_score: float, decay_days: float) -> DataFrame:
    """(query, row) of the entries in the blocks of ``wanted`` tokens (query, token, q) that can still score; skipped blocks are not unpacked."""
    bound = lambda time: F.col("q") * recency(age_days(now, time), decay_days)
    if floors is not None:
        wanted = wanted.join(floors, "query", "left").withColumn("need", F.greatest(F.coalesce("floor", F.lit(min_score)), F.lit(min_score)))
    else:
        wanted = wanted.withColumn("need", F.lit(min_score))
    met = blocks.join(wanted, "token").where(bound("newest") >= F.col("need"))
    return met.select("query", "q", "need", F.explode("entries").alias("e")).where(bound("e.time") >= F.col("need")).select("query", F.col("e.row").alias("row")).distinct()


def search(spark: SparkSession, path: str, queries: DataFrame, query_key: str, query_text: str, now: datetime, entry_key: str = "entry", min_score: float = MIN_SCORE, top_k: int = TOP_K, rare_below: float = RARE_BELOW, stop_words: Sequence[str] = STOP_WORDS, decay_days: float = DECAY_DAYS) -> DataFrame:
    """(query_key, rank, entry_key, score): each query's best entries of the index; ties go to the smaller key.

    Results are those of ``relevance.rank`` over all entries that were appended. ``query_key`` names one query; queries of no
    rare token, or too few of them to reach ``min_score``, find nothing.
    """
    found = segments(spark, path)
    schema_of = lambda df: df.select(F.col("query").alias(query_key), "rank", F.col("key").alias(entry_key), "score")
    if not found:
        raise FileNotFoundError(f"no segment at {path}")
    moment = F.lit(now)
    entries = spark.read.parquet(*(f"{at}/entries" for at in found))
    blocks = spark.read.parquet(*(f"{at}/blocks" for at in found))
    asked = written(_asked(spark, found, queries, query_key, query_text, rare_below, stop_words), "asked")
    best = blocks.agg(F.max(recency(age_days(moment, "newest"), decay_days)).alias("r")).first().r or 0.0
    least = max(1, -int(-(min_score / best - 1e-9) // 1)) if best > 0 else 1
    wanted = essential(asked, least)
    sets = asked.groupBy("query").agg(F.collect_set("token").alias("own"))
    top, upper = None, None
    for share in ROUNDS:
        fresh = recency(age_days(moment, "newest"), decay_days)
        own = blocks.where((fresh >= share * best) & (fresh < upper if upper is not None else F.lit(True)))
        upper = share * best
        floors = None if top is None else top.where(F.col("rank") == top_k).select("query", F.col("score").alias("floor"))
        pairs = written(read_blocks(own, wanted, moment, floors, min_score, decay_days), "pairs")
        few = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        held = entries.join(few, "row").join(sets, "query")
        scored = held.select("query", "key", "row", (F.size(F.array_intersect("tokens", "own")) * recency(age_days(moment, "time"), decay_days)).alias("score")).where(F.col("score") >= min_score)
        if top is not None:
            scored = scored.unionByName(top.drop("rank")).dropDuplicates(["query", "row"])
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key", "row")
        top = written(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k), "top")
    return schema_of(top)
