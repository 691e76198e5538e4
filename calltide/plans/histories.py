"""Driver queries on structures that are kept and on histories: the index, gates over time, joins in time, differences of logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from calltide.operators import evaluate, expansion, gates, intime, postings, reconcile, sketches
from calltide.plans import registry, surface
from calltide.plans.registry import query
from calltide.sources import calllog
from calltide.sources.scratch import scratch


@query(registry._RELEVANCE)
def relevance_indexed(spark, load):
    """relevance_topk's results from an index that two appends made."""
    now = datetime(2026, 5, 8)
    timed = load("documents").select("doc_id", "text", F.expr("TIMESTAMP_NTZ '2026-05-08' - make_dt_interval(CAST(doc_id % 50 AS INT))").alias("time"))
    path = scratch(spark, "index")
    for part in ("doc_id % 3 = 0", "NOT coalesce(doc_id % 3 = 0, false)"):
        postings.append(timed.where(part), path, "doc_id", "text", "time")
    return postings.search(spark, path, load("benchmark"), "item_id", "text", now, entry_key="doc_id", min_score=2.0)


@query(f"""
    WITH e AS (SELECT event_id, ts, event_type = 'purchase' AS mine, CAST(value AS DECIMAL(28,8)) AS cost, {registry._K} AS k FROM events),
    w AS (SELECT event_id AS seq, ts, mine, count(*) FILTER (mine) OVER week AS wrapped_calls, CAST(sum(cost) FILTER (mine) OVER week AS DOUBLE) / count(cost) FILTER (mine) OVER week AS wrapped_avg,
              count(*) OVER week AS baseline_calls, CAST(sum(cost) OVER week AS DOUBLE) / count(cost) OVER week AS baseline_avg,
              CAST(coalesce(sum(CAST(k * 0.001 AS DECIMAL(28,8))) FILTER (mine) OVER week, 0) AS DOUBLE) AS hours
          FROM e WINDOW week AS (ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)),
    f AS (SELECT event_id AS seq, count(*) OVER five AS last_rows, count(*) FILTER (k % 2 = 0) OVER five AS flagged FROM e WHERE mine WINDOW five AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    r AS (SELECT *, CASE WHEN wrapped_avg <> 0 AND baseline_avg > 0 THEN wrapped_avg / baseline_avg END AS ratio FROM w JOIN f USING (seq)),
    s AS (SELECT *, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio > 1.5 THEN 'abort' WHEN ratio > 1.35 THEN 'warn' ELSE 'ok' END AS ratio_status,
              CASE WHEN last_rows < 5 THEN 'unknown' WHEN flagged < 2 THEN 'abort' WHEN flagged = 2 THEN 'warn' ELSE 'ok' END AS flag_status,
              CASE WHEN hours > 2.0 THEN 'abort' WHEN hours > 1.8 THEN 'warn' ELSE 'ok' END AS hours_status FROM r)
    SELECT seq, ts, wrapped_calls, wrapped_avg, baseline_calls, baseline_avg, ratio, ratio_status, CAST(last_rows AS INT) AS last_rows, CAST(flagged AS INT) AS flagged, flag_status, hours, hours_status,
           CASE WHEN 'abort' IN (ratio_status, flag_status, hours_status) THEN 'ABORT' WHEN ratio_status <> 'ok' OR flag_status <> 'ok' OR hours_status <> 'ok' THEN 'EXTEND' ELSE 'CONTINUE' END AS verdict FROM s""")
def gate_history(spark, load):
    e = load("events")
    told = gates.history(registry._metrics(e), registry._baseline(e))
    return told.select("seq", "ts", "wrapped_calls", "wrapped_avg", "baseline_calls", "baseline_avg", "ratio", "ratio_status", "last_rows", "flagged", "flag_status", "hours", "hours_status", "verdict")


_METRIC = "event_type IN ('click', 'purchase')"


@query(f"""
    WITH c AS (SELECT event_id, user_id, ts, event_type FROM events WHERE NOT {_METRIC}),
    m AS (SELECT user_id, ts, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events WHERE {_METRIC} GROUP BY user_id, ts)
    SELECT event_id, c.user_id, event_type, CASE WHEN c.ts - m.ts <= INTERVAL 12 HOURS THEN seq END AS metric_id, CASE WHEN c.ts - m.ts <= INTERVAL 12 HOURS THEN value END AS metric_value
    FROM c ASOF LEFT JOIN m ON c.user_id = m.user_id AND c.ts >= m.ts""")
def calls_metrics_asof(spark, load):
    e = load("events")
    metrics = e.where(_METRIC).select("user_id", "ts", F.col("event_id").alias("seq"), "value")
    joined = intime.asof_join(e.where(f"NOT {_METRIC}").select("event_id", "user_id", "ts", "event_type"), metrics, by=["user_id"], tolerance_us=12 * intime.HOUR_US)
    return joined.select("event_id", "user_id", "event_type", F.col("m.seq").alias("metric_id"), F.col("m.value").alias("metric_value"))


@query(f"""
    SELECT c.event_id, m.event_id AS metric_id, epoch_us(m.ts) - epoch_us(c.ts) AS apart FROM events c JOIN events m ON c.user_id = m.user_id AND m.ts BETWEEN c.ts - INTERVAL 6 HOURS AND c.ts + INTERVAL 2 HOURS
    WHERE c.event_type = 'view' AND m.{_METRIC}""")
def calls_metrics_interval(spark, load):
    e = load("events").select("event_id", "user_id", "ts", "event_type")
    met = intime.interval_join(e.where("event_type = 'view'"), e.where(_METRIC), 6 * intime.HOUR_US, 2 * intime.HOUR_US, by=["user_id"])
    return met.select("event_id", F.col("m.event_id").alias("metric_id"), (intime.micros(F.col("m.ts")) - intime.micros("ts")).alias("apart"))


_STATES = """
    WITH e AS (SELECT event_id, user_id, event_type, value FROM events), o AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 5 = 0),
    kept AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM e WHERE event_id % 11 <> 0),
    n AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE event_id % 3 = 0 UNION ALL SELECT 10000000 + event_id, user_id, event_type, value FROM e WHERE event_id % 17 = 0)
"""


def _states(load):
    """Two states of a log: rows of the first go, change, repeat more or less often, and new ones come."""
    e = load("events").select("event_id", "user_id", "event_type", "value")
    kept = e.where("event_id % 11 <> 0").withColumn("value", F.expr("CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END"))
    new = kept.unionByName(kept.where("event_id % 3 = 0")).unionByName(e.where("event_id % 17 = 0").withColumn("event_id", F.col("event_id") + 10_000_000))
    return e.unionByName(e.where("event_id % 5 = 0")), new


@query(_STATES + """, gone AS (SELECT *, count(*) AS c FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) GROUP BY ALL), came AS (SELECT *, count(*) AS c FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) GROUP BY ALL),
    g AS (SELECT event_id, sum(c) AS c FROM gone GROUP BY event_id), h AS (SELECT event_id, sum(c) AS c FROM came GROUP BY event_id), u AS (SELECT event_id FROM g JOIN h USING (event_id) WHERE g.c = 1 AND h.c = 1)
    SELECT 'update' AS op, event_id AS key, gone.value AS old_value, came.value AS new_value, CAST(1 AS BIGINT) AS copies FROM u JOIN gone USING (event_id) JOIN came USING (event_id)
    UNION ALL SELECT 'delete', event_id, value, NULL, c FROM gone WHERE event_id NOT IN (SELECT event_id FROM u)
    UNION ALL SELECT 'insert', event_id, NULL, value, c FROM came WHERE event_id NOT IN (SELECT event_id FROM u)""")
def log_changes(spark, load):
    return reconcile.change_feed(*_states(load), "event_id").select("op", "key", F.col("before.value").alias("old_value"), F.col("after.value").alias("new_value"), "copies")


@query(_STATES + "SELECT * FROM n")
def log_reapplied(spark, load):
    """The new state again, made of the old one and the feed."""
    old, new = _states(load)
    return reconcile.apply_feed(old, reconcile.change_feed(old, new, "event_id"))


@query(f"""
    WITH r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'forgetting' ELSE 'strategic' END AS kind, lang AS condition, source AS variant, {registry._hits(registry.MARKERS)} AS hits FROM documents),
    c AS (SELECT kind, condition, variant, grouping_id(kind, condition, variant) AS level, sum(least(hits / 4.0::DOUBLE, 1.0::DOUBLE)) / count(*) AS mean_score, sum(hits) / count(*) AS mean_hits, count(*) AS n
          FROM r GROUP BY GROUPING SETS ((kind, condition, variant), (kind, condition), (kind, variant), (kind), ()))
    SELECT c.kind, c.condition, c.variant, c.level, c.mean_score, c.mean_hits, c.n, c.mean_score - t.mean_score AS delta
    FROM c LEFT JOIN c t ON t.level = (c.level | 1) AND t.kind IS NOT DISTINCT FROM c.kind AND t.condition IS NOT DISTINCT FROM c.condition""")
def score_cube(spark, load):
    rows = load("documents").select(F.expr("CASE WHEN doc_id % 5 = 0 THEN 'forgetting' ELSE 'strategic' END").alias("kind"), F.col("lang").alias("condition"), F.col("source").alias("variant"), "text")
    dims = ["kind", "condition", "variant"]
    return evaluate.condition_cube(rows, dims, [dims, ["kind", "condition"], ["kind", "variant"], ["kind"], []], "variant", text="text", markers=registry.MARKERS)


@query("""
    WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
    SELECT d.day, count(*) AS calls, count(DISTINCT user_id) AS users, TRUE AS users_close, TRUE AS medians_close, TRUE AS tails_close
    FROM d JOIN events e ON CAST(e.ts AS DATE) BETWEEN d.day - 6 AND d.day GROUP BY d.day""")
def weekly_sketches(spark, load):
    """For the week that ends with each day: exact counts, and whether the merged sketches are within their bounds of them."""
    e = load("events").select("ts", "user_id", "value", F.to_date("ts").alias("day"))
    told = sketches.merged(sketches.daily(e, "ts", F.col("user_id"), F.col("value")), 7)
    told = told.select("day", "calls", sketches.distinct_estimate().alias("about"), sketches.quantile_estimate(0.5).alias("half"), sketches.quantile_estimate(0.95).alias("most"))
    weeks = e.withColumn("end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.date_add("day", k)))).drop("day")
    met = weeks.join(F.broadcast(told), weeks["end"] == told["day"])
    share = lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    exact = met.groupBy("day", "calls", "about").agg(F.countDistinct("user_id").alias("users"), share("half").alias("at_half"), share("most").alias("at_most"))
    close = lambda c, p: F.abs(F.col(c) - p) <= sketches.RANK_ERROR + 1 / F.col("calls")
    return exact.select("day", "calls", "users", (F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * sketches.DISTINCT_ERROR)).alias("users_close"), close("at_half", 0.5).alias("medians_close"), close("at_most", 0.95).alias("tails_close"))


def sentences(text: str) -> list[str]:
    """A callable in the place of a model: the sentences of a text; a text of one line fails."""
    if "\n" not in text:
        raise ValueError("one line only")
    return [s.strip(" \n") for s in text.split(".") if s.strip(" \n")]


@query("""
    WITH c AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
    s AS (SELECT id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') AS items FROM c WHERE contains(text, chr(10)))
    SELECT id, CAST(k AS INT) AS place, items[k + 1] AS item, NULL AS error FROM (SELECT id, items, unnest(range(len(items))) AS k FROM s)
    UNION ALL SELECT id, NULL, NULL, CASE WHEN text IS NULL THEN 'no text' ELSE 'ValueError: one line only' END FROM c WHERE text IS NULL OR NOT contains(text, chr(10))""")
def seed_expansion(spark, load):
    seeds = load("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return expansion.expand(seeds, "id", "text", sentences)


@query("SELECT conv_id, turn, role, text FROM conversations")
def log_source(spark, load):
    """Conversations written as a log by two jobs, and read from it."""
    calllog.register(spark)
    rows, path = load("conversations").select("conv_id", "turn", "role", "text"), scratch(spark, "log")
    for part in ("turn % 2 = 0", "NOT coalesce(turn % 2 = 0, false)"):
        rows.where(part).write.format("calllog").mode("append").save(path)
    read = spark.read.format("calllog").option("path", path).load()
    return calllog.fields(read, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", "text")


def _installed(spark, load) -> None:
    e = load("events")
    called = load("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("role").alias("label"), F.col("text").alias("query"), F.when(F.col("turn") % 2 == 1, F.upper("text")).alias("response"))
    surface.install(spark, called, registry._metrics(e), registry._baseline(e))


@query(f"""
    WITH e AS (SELECT ts, event_type = 'purchase' AS mine, CAST(value AS DECIMAL(28,8)) AS cost, {registry._K} AS k FROM events), d AS (SELECT CAST(ts AS DATE) AS day, max(ts) AS moment FROM events GROUP BY ALL),
    s AS (SELECT day, count(*) FILTER (mine) AS wrapped_calls, count(*) AS baseline_calls, CAST(sum(cost) FILTER (mine) AS DOUBLE) / nullif(count(cost) FILTER (mine), 0) AS a, CAST(sum(cost) AS DOUBLE) / nullif(count(cost), 0) AS b,
                 CAST(coalesce(sum(CAST(k * 0.001 AS DECIMAL(28,8))) FILTER (mine), 0) AS DOUBLE) AS hours FROM d JOIN e ON e.ts >= d.moment - INTERVAL 3 DAYS AND e.ts <= d.moment GROUP BY day)
    SELECT day, wrapped_calls, baseline_calls, ratio, hours, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio > 1.02 THEN 'abort' WHEN ratio > 1.0 THEN 'warn' ELSE 'ok' END AS ratio_status
    FROM (SELECT *, CASE WHEN a <> 0 AND b > 0 THEN a / b END AS ratio FROM s)""")
def sql_gates(spark, load):
    _installed(spark, load)
    return spark.sql("""
        SELECT d.day, g.* FROM (SELECT to_date(ts) AS day, max(ts) AS moment FROM calltide_baseline GROUP BY to_date(ts)) d,
        LATERAL calltide_gates(moment => d.moment, days => 3, abort_above => 1.02, warn_above => 1.0) g""")


@query("SELECT conv_id * 1000 + turn AS seq, role AS label FROM conversations WHERE contains(lower(text), 'tion d') OR contains(lower(role), 'tion d')")
def sql_search(spark, load):
    _installed(spark, load)
    return spark.sql("SELECT seq, label FROM calltide_search(needle => 'TION D')")


@query(f"""
    WITH c AS (SELECT conv_id * 1000 + turn AS seq, role AS label, text, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC) AS place FROM conversations)
    SELECT label, CAST(place AS INT) AS place, seq, least({registry._hits(registry.MARKERS[:3])} / 3.0::DOUBLE, 1.0::DOUBLE) AS score FROM c WHERE place <= 25""")
def sql_latest(spark, load):
    _installed(spark, load)
    markers = ", ".join(f"'{m}'" for m in registry.MARKERS[:3])
    return spark.sql(f"SELECT l.label, l.place, l.seq, calltide_score(query, array({markers}), cap => 3) AS score FROM calltide_latest(per_label => 25) l JOIN calltide_calls USING (seq)")
