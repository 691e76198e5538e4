"""Driver queries that write in the shared folder and read back: logs, folders of documents, reports, streams; and calls of functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from calltide.functions import text as T
from calltide.operators import campaign, intime, relevance
from calltide.plans import registry, reports
from calltide.plans.registry import query
from calltide.sources import readers, sinks
from calltide.sources.scratch import scratch
from calltide.streaming import logs


def _call_log(load, path: str):
    """Events as a call log of two appends, with lines that are blank, no JSON or of another shape between them."""
    e = load("events").withColumn("k", registry._k(load("events")))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    usage = F.when(F.col("k") % 3 == 0, F.struct(F.col("value").alias("cost")))
    rows = e.select(
        stamp.alias("timestamp"), F.when(F.col("event_type") == "signup", "wargame-vision").alias("mode"), F.concat(F.lit("q é "), F.col("event_id").cast("string")).alias("query"), F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("template"),
        F.col("event_id").alias("latency_ms"), F.when(F.col("k") % 4 != 0, F.col("value")).alias("cost_usd"), F.array(F.format_string("%02d", "k"), F.lit("x"), F.lit("7")).alias("retrieved_corpus_ids"), usage.alias("usage"),
    )
    sinks.overwrite_jsonl(rows.where("event_type = 'error'"), path)
    sinks.overwrite_jsonl(rows.where("latency_ms % 2 = 0"), path)  # takes the place of what was there
    sinks.append_jsonl(rows.where("latency_ms % 2 = 1"), path)
    e.select(F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "not json").otherwise('{"timestamp": 7, "latency_ms": null').alias("value")).write.mode("append").text(path)


@query(f"""
    WITH e AS (SELECT *, {registry._K} AS k FROM events)
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN event_type = 'signup' THEN 'wargame-vision' END AS mode, 'q é ' || event_id AS query, CASE WHEN k % 2 = 0 THEN event_type END AS template, event_id AS latency_ms,
           CASE WHEN k % 4 <> 0 THEN value END AS cost_usd, CASE WHEN k % 3 = 0 THEN value END AS usage_cost, array_to_string(list_sort(list_distinct([k, 7])), ',') AS ids, k % 2 <> 0 AS null_template FROM e""")
def call_log_roundtrip(spark, load):
    path = scratch(spark, "calls")
    _call_log(load, path)
    read = readers.read_calls(spark, path)
    from calltide.functions.values import int_ids

    ids = F.array_join(F.transform(int_ids("retrieved_corpus_ids"), lambda x: x.cast("string")), ",")
    return read.select("timestamp", "mode", "query", "template", "latency_ms", "cost_usd", "usage_cost", ids.alias("ids"), F.array_contains("nulls", "template").alias("null_template"))


@query(f"""
    WITH e AS (SELECT *, {registry._K} AS k FROM events)
    SELECT event_id AS latency_ms, CASE k % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS conclusion_changed, CASE k % 3 WHEN 0 THEN value WHEN 1 THEN 1.0 END AS cost_usd, k % 5 AS exit_code FROM e""")
def metric_log_roundtrip(spark, load):
    """Flags are true only for JSON true; costs are JSON numbers or booleans, not digits in a string."""
    e, path = load("events").withColumn("k", registry._k(load("events"))), scratch(spark, "metrics")
    flag = F.element_at(F.array(*map(F.lit, ("true", "false", '"true"', "1"))), (F.col("k") % 4 + 1).cast("int"))
    cost = F.when(F.col("k") % 3 == 0, F.col("value").cast("string")).when(F.col("k") % 3 == 1, "true").otherwise('"0.5"')
    line = F.concat(F.lit('{"latency_ms":'), F.col("event_id").cast("string"), F.lit(',"conclusion_changed":'), flag, F.lit(',"cost_usd":'), cost, F.lit(',"exit_code":'), (F.col("k") % 5).cast("string"), F.lit("}"))
    e.select(line.alias("value")).write.text(path)
    return readers.read_metrics(spark, path).select("latency_ms", "conclusion_changed", "cost_usd", "exit_code")


@query("SELECT conv_id, turn, role, text FROM conversations")
def strict_log_roundtrip(spark, load):
    rows, path = load("conversations").select("conv_id", "turn", "role", "text"), scratch(spark, "strict")
    sinks.overwrite_jsonl(rows, path)
    return readers.read_strict(spark, path, ST.StructType(rows.schema.fields))


@query("SELECT 'item_id=' || item_id AS item, text || chr(10) AS text, octet_length(encode(text)) + 1 AS length FROM benchmark")
def folder_roundtrip(spark, load):
    """A folder of one file for each benchmark item: whole texts and the files' sizes."""
    path = scratch(spark, "folder")
    load("benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    item = lambda c: F.element_at(F.split(c, "/"), -2)
    whole = readers.documents(spark, path, "*.txt").select(item("path").alias("item"), "text")
    sizes = readers.files(spark, path, "*.txt").select(item("path").alias("item"), "length")
    return whole.join(sizes, "item")


@query(f"""
    WITH m AS (SELECT *, {registry._K} AS k FROM events)
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, value AS cost_usd, CASE WHEN k % 2 = 0 THEN TRUE END AS conclusion_changed FROM m WHERE event_id % 4 <> 1""")
def stream_roundtrip(spark, load):
    """The log as a stream of files, read in two runs of one checkpoint; rows of unreadable times are left out."""
    e, path, out = load("events").withColumn("k", registry._k(load("events"))), scratch(spark, "stream"), scratch(spark, "streamed")
    bad_time = F.col("event_id") % 4 == 1
    line = F.to_json(F.struct(F.when(bad_time, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), F.col("value").alias("cost_usd"), F.when(F.col("k") % 2 == 0, F.lit(True)).alias("conclusion_changed")))
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        e.where(part).select(line.alias("value")).write.mode("append").text(path)
        logs.write_once(logs.stream_metrics(spark, path), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).select("timestamp", "cost_usd", "conclusion_changed")


@query("""
    WITH t AS (SELECT user_id, count(*) AS turns FROM events WHERE event_type = 'view' GROUP BY user_id),
    old AS (SELECT user_id AS slug, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn, event_type AS model FROM events WHERE event_type = 'view'),
    new AS (SELECT c_custkey AS slug, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE coalesce(turns, 0) + 1 END AS turn, 'large' AS model FROM customer LEFT JOIN t ON t.user_id = c_custkey),
    u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
    SELECT slug, turn, model, turn = max(turn) OVER (PARTITION BY slug) AS current FROM u""")
def turns_issued(spark, load):
    """A new turn for every campaign: numbered by itself or one above the newest, and the newest is current."""
    from pyspark.sql import Window

    views = load("events").where("event_type = 'view'")
    old = views.select(F.col("user_id").alias("slug"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("turn"), F.col("event_type").alias("model"), F.lit(False).alias("current"))
    new = load("customer").select(F.col("c_custkey").alias("slug"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("turn"), F.lit("vendor/large").alias("model"))
    return campaign.issue_turn(old, new.withColumn("current", F.lit(True))).select("slug", "turn", "model", "current")


@query("SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey % 5000 AS VARCHAR)) >= 3 THEN CAST(o_orderkey % 5000 AS VARCHAR) ELSE lpad(CAST(o_orderkey % 5000 AS VARCHAR), 3, '0') END AS shown FROM orders")
def ordinals(spark, load):
    return load("orders").select("o_orderkey", T.ordinal(F.col("o_orderkey") % 5000, 3).alias("shown"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN CASE WHEN doc_id % 11 = 4 THEN '4' ELSE array_to_string(list_sort([doc_id % 11, 4]), ',') END END AS ids,
           CASE WHEN doc_id % 7 = 0 THEN 'ValueError: ' || doc_id WHEN doc_id % 5 = 0 THEN 'exit code 2' END AS error FROM documents""")
def corpus_scan(spark, load):
    """The ids in what a command says about each document; the command may raise, or end with a code."""

    def command(asked: str) -> dict:
        n = int(asked)
        if n % 7 == 0:
            raise ValueError(asked)
        return {"output": f"## Reference: corpus #{n % 11}\ntext\n## Reference: corpus #4\n", "code": 2 if n % 5 == 0 else 0}

    called = readers.scan_corpus_ids(load("documents").select("doc_id", F.col("doc_id").cast("string").alias("asked")), "asked", command)
    return called.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "error")


@query(registry._RELEVANCE.replace("SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 3", """, b AS (SELECT item_id, string_agg('- [ ] **match ' || (item_id + 1) || '.' || rank || '** score ' || printf('%.2f', score) || ': ' || left(replace(text, chr(10), ' '), 150), chr(10) ORDER BY rank) AS boxes FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id)
    SELECT item_id AS idx, md5('## Query ' || (item_id + 1) || chr(10) || chr(10) || '> ' || left(replace(text, chr(10), ' '), 200) || chr(10) || chr(10) || coalesce(boxes, '_(no matches)_') || chr(10)) AS digest FROM benchmark LEFT JOIN b USING (item_id)"""))
def precision_sheet(spark, load):
    """The sheet for precision to be counted from, a row per query, written as text and read back."""
    targets = load("benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("query"))
    entries = load("documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("query"))
    path = scratch(spark, "sheet")
    reports.score_sheet_rows(targets, entries, F.col("seq") % 50, min_score=2.0).write.json(path)
    return spark.read.schema("idx long, section string").json(path).select("idx", F.md5("section").alias("digest"))


@query(registry._VERDICT + "SELECT conv_id * 1000 + turn AS idx, left(text, 80) AS query, verdict, outcome FROM o JOIN conversations USING (conv_id, turn)")
def judge_report_roundtrip(spark, load):
    """Every judged pair as a line of the report's details."""
    judged = registry._judged(load).select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("query"), "candidate_slot", "raw_judge", "verdict", "outcome")
    path = scratch(spark, "details")
    sinks.append_jsonl(reports.judge_details(judged), path)
    return readers.read_strict(spark, path, "idx long, query string, verdict string, outcome string")


@query("""
    WITH c AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events),
    q AS (SELECT user_id, rank, '### ' || strftime(ts, '%Y') || ' — template:' || event_type || ' — shared corpus IDs: [' || CASE WHEN event_id % 4 = 2 THEN '2' ELSE '' END || ']' || chr(10) || chr(10) || '**Prior query:** q' || event_id || chr(10) || chr(10) || '**Prior response (excerpt):** ' || event_type || chr(10) || chr(10) AS text FROM c),
    s AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY user_id ORDER BY rank) AS cost FROM q)
    SELECT user_id, count(*) FILTER (cost <= 400) AS fits, md5(coalesce(string_agg(text, chr(10) ORDER BY rank) FILTER (cost <= 400), '')) AS digest FROM s GROUP BY user_id""")
def preamble_texts(spark, load):
    """Each user's calls quoted in order as long as they fit the budget."""
    e = load("events")
    rows = e.select("user_id", F.col("event_id").alias("rank"), F.date_format("ts", "yyyy").alias("timestamp"), F.col("event_type").alias("template"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query"), F.col("event_type").alias("response"), F.array((F.col("event_id") % 4).cast("string")).alias("retrieved_corpus_ids"))
    quoted = rows.withColumn("t", relevance.entry_text([2, 9])).withColumn("c", T.token_estimate("t"))
    fits = relevance.budget_prefix(quoted, "c", 400, ["rank"], ["user_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n")
    told = fits.groupBy("user_id").agg(F.count(F.lit(1)).alias("fits"), joined.alias("body"))
    return e.select("user_id").distinct().join(told, "user_id", "left").select("user_id", F.coalesce("fits", F.lit(0)).alias("fits"), F.md5(F.coalesce("body", F.lit(""))).alias("digest"))


@query("""
    SELECT d.doc_id, row_number() OVER (ORDER BY quality DESC NULLS LAST, d.doc_id) - 1 AS by_quality_down, row_number() OVER (ORDER BY source ASC NULLS LAST, d.doc_id) - 1 AS by_source_up,
           row_number() OVER (ORDER BY toxic = 1 DESC NULLS LAST, d.doc_id) - 1 AS by_toxic_down, row_number() OVER (ORDER BY n_chars / 3.0::DOUBLE ASC NULLS LAST, d.doc_id) - 1 AS by_length_up FROM documents d LEFT JOIN labels USING (doc_id)""")
def calls_sort_places(spark, load):
    """Where each row stands in the orders of a number, a text, a boolean and a fraction, in both directions, nulls last."""
    d = load("documents").join(load("labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic")), "doc_id", "left").select("doc_id", "quality", "source", "toxic", (F.col("n_chars") / 3.0).alias("length"))
    orders = {"by_quality_down": F.col("quality").desc_nulls_last(), "by_source_up": F.col("source").asc_nulls_last(), "by_toxic_down": F.col("toxic").desc_nulls_last(), "by_length_up": F.col("length").asc_nulls_last()}
    out = d.select("doc_id")
    for name, order in orders.items():
        out = out.join(intime.numbered(d, [order, "doc_id"], name).select("doc_id", name), "doc_id")
    return out
