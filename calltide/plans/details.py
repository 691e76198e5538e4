"""More driver queries: the smaller operators (formats, estimates, checks, listings) over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.functions import text as T
from calltide.functions import values as V
from calltide.operators import campaign, distill, documents, evaluate, orders, relevance
from calltide.plans.registry import query
from calltide.plans.reports import missing_files
from calltide.sources import readers, sinks

_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 330 MINUTES, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts + INTERVAL 60 MINUTES, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def timestamps_parse(spark, load):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.element_at(F.array(*map(F.lit, ("Z", "+0530", "-01:00", ".5Z", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return load("events").select("event_id", F.date_format(V.parse_timestamp(F.concat(stamp, tail)), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("""
    SELECT event_id, event_id * 7 + 1 AS elapsed, strftime(ts, '%b ') || day(ts) || ' · ' || strftime(ts, '%H:%M') AS shown, 'eval-' || strftime(ts, '%Y-%m-%d') || '.jsonl' AS file FROM events""")
def time_formats(spark, load):
    e = load("events").withColumn("end", F.timestamp_add("MICROSECOND", F.col("event_id") * 7000 + 1999, F.col("ts")))
    return e.select("event_id", V.elapsed_ms("ts", "end").alias("elapsed"), T.display_time("ts").alias("shown"), T.dated_name("eval", "ts", ".jsonl").alias("file"))


@query("""
    WITH a AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS day, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS today FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN '' WHEN 1 THEN 'no date ' || o_orderkey WHEN 2 THEN CASE WHEN today - day <= 0 THEN 'today' WHEN today - day = 1 THEN '1 day ago' WHEN today - day < 30 THEN (today - day) || ' days ago' ELSE ((today - day) // 30) || ' mo ago' END
           ELSE CASE WHEN today - day <= 0 THEN 'today' WHEN today - day = 1 THEN '1 day ago' WHEN today - day < 30 THEN (today - day) || ' days ago' ELSE ((today - day) // 30) || ' mo ago' END END AS age FROM a""")
def age_labels(spark, load):
    o = load("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 4).alias("k"))
    iso = F.date_format("day", "yyyy-MM-dd")
    written = F.when(F.col("k") == 0, "").when(F.col("k") == 1, F.concat(F.lit("no date "), F.col("o_orderkey").cast("string"))).when(F.col("k") == 2, iso).otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    today = o.agg(F.max("day").alias("today"))
    return o.join(F.broadcast(today)).select("o_orderkey", V.age_label(written, F.col("today")).alias("age"))


@query(f"""
    SELECT doc_id, CASE WHEN length(text) > 100 THEN regexp_replace(left(text, 99), '\\s+$', '') || '…' ELSE text END AS cut, md5(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed,
           len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) BETWEEN 50 AND 300 AS on_target, md5(regexp_replace('<p>' || text || '<br/>', '<[^>]+>', '', 'g')) AS untagged,
           md5('> ' || replace({_STRIPPED.format("text")}, chr(10), chr(10) || '> ')) AS quoted FROM documents WHERE {_STRIPPED.format("text")} <> ''""")
def text_formats(spark, load):
    d = load("documents").where(T.strip("text") != "")
    tagged = T.strip_tags(F.concat(F.lit("<p>"), F.col("text"), F.lit("<br/>")))
    return d.select("doc_id", T.truncate("text", 100).alias("cut"), F.md5(T.collapse_space("text")).alias("collapsed"), T.words_on_target("text").alias("on_target"), F.md5(tagged).alias("untagged"), F.md5(T.block_quote("text")).alias("quoted"))


_NAMES = "CASE p_partkey % 6 WHEN 0 THEN 'book-' || p_partkey || '.md' WHEN 1 THEN 'book-' || p_partkey || '.digest.md' WHEN 2 THEN 'a/' || p_partkey || '.png' WHEN 3 THEN '../x.JPG' WHEN 4 THEN ' ' ELSE 'red-wave-' || p_partkey || '.pdf' END"


def _named(load) -> DataFrame:
    return load("part").select("p_partkey", F.expr(_NAMES).alias("name"), (F.col("p_size").cast("long") * 100_000).alias("length"))


@query(f"SELECT p_partkey, p_partkey % 6 IN (0, 1, 5) AS safe, p_partkey % 6 = 0 AS book FROM part")
def safe_names(spark, load):
    return _named(load).select("p_partkey", T.safe_name("name").alias("safe"), T.safe_book("name").alias("book"))


@query(f"""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN '.png' WHEN 3 THEN '.jpg' WHEN 4 THEN '' WHEN 5 THEN '.pdf' ELSE '.md' END AS ext, CASE p_partkey % 6 WHEN 0 THEN 'book-' || p_partkey || '.digest.md' WHEN 1 THEN 'book-' || p_partkey || '.digest.digest.md' END AS digest,
           CASE p_partkey % 6 WHEN 0 THEN 'book-' || p_partkey WHEN 1 THEN 'book-' || p_partkey WHEN 5 THEN 'red-wave-' || p_partkey END AS parent, CASE p_partkey % 6 WHEN 5 THEN 'Red Wave ' || p_partkey || '.Pdf' END AS title,
           CASE WHEN p_partkey < 10 THEN '0' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS number, p_size * 100000 > 2097152 AS large FROM part""")
def file_names(spark, load):
    rows, kind = readers.with_size_flag(_named(load)), F.col("p_partkey") % 6
    return rows.select(
        "p_partkey", T.extension("name").alias("ext"), F.when(kind.isin(0, 1), T.digest_name("name")).alias("digest"), F.when(kind.isin(0, 1, 5), T.digest_parent("name")).alias("parent"),
        F.when(kind == 5, T.title_from_slug("name")).alias("title"), T.ordinal("p_partkey").alias("number"), "large",
    )


@query(f"""
    SELECT p_partkey, CASE WHEN p_partkey % 6 IN (2, 3) AND p_size * 100000 > 4000000 THEN 'error' WHEN p_partkey % 6 IN (0, 1, 5) THEN 'rules' WHEN p_partkey % 6 IN (2, 3) THEN 'reference' ELSE 'error' END AS route,
           CASE WHEN p_partkey % 6 IN (2, 3) AND p_size * 100000 > 4000000 THEN 'image too large' WHEN p_partkey % 6 = 4 THEN 'unsupported type ' END AS error FROM part""")
def upload_routes(spark, load):
    return sinks.route_uploads(_named(load).withColumn("length", F.col("length") * 20_971_520 / 4_000_000)).select("p_partkey", "route", "error")


@query("""
    WITH f AS (SELECT p_partkey, p_partkey % 6 AS kind, 'b' || (p_partkey // 6) AS stem, p_size * 100000 AS size FROM part)
    SELECT 'rules' AS kind, b.stem || '.md' AS name, b.size AS size_bytes, b.size // 4 AS tokens_est, CASE WHEN p.stem IS NULL THEN 'uploaded markdown' ELSE 'converted from pdf' END AS source, d.stem IS NOT NULL AS has_digest, d.size // 4 AS digest_tokens_est
    FROM f b LEFT JOIN f d ON d.kind = 1 AND d.stem = b.stem LEFT JOIN f p ON p.kind = 2 AND p.size > 2000000 AND p.stem = b.stem WHERE b.kind = 0
    UNION ALL SELECT 'reference', stem || '.png', size, NULL, NULL, FALSE, NULL FROM f WHERE kind = 3""")
def source_listing(spark, load):
    kind = F.col("p_partkey") % 6
    f = load("part").select(kind.alias("k"), F.concat(F.lit("b"), F.floor(F.col("p_partkey") / 6).cast("string")).alias("stem"), (F.col("p_size").cast("long") * 100_000).alias("length"))
    named = lambda k, tail: f.where(F.col("k") == k).select(F.concat("stem", F.lit(tail)).alias("name"), "length", F.lit(tail[-4:] if k > 1 else ".md").alias("ext"))
    rules = named(0, ".md").unionByName(named(1, ".digest.md")).unionByName(named(2, ".pdf").where("length > 2000000"))
    return readers.source_list(rules, named(3, ".png")).drop("digest_size_bytes")


@query("SELECT count(*) AS files, CAST(sum(p_size * 997) AS BIGINT) AS bytes, CAST(sum(floor(p_size * 997 / 1024.0::DOUBLE + 0.5)) AS BIGINT) AS kb, CAST(sum(p_size * 997 // 4) AS BIGINT) AS tokens_est FROM part")
def file_totals(spark, load):
    return readers.file_totals(load("part").select((F.col("p_size").cast("long") * 997).alias("length")))


@query("SELECT r_name AS template, count(*) AS seeds FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT NULL, count(*) FROM nation")
def seed_totals(spark, load):
    seeds = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("template")).agg(F.collect_list("n_name").alias("seeds"))
    return distill.seed_totals(seeds)


@query("SELECT lang AS template, CAST(row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS INT) AS seed_idx, source AS seed FROM (SELECT DISTINCT lang, source FROM documents WHERE source IS NOT NULL)")
def seed_rows(spark, load):
    groups = load("documents").groupBy(F.col("lang").alias("template")).agg(F.sort_array(F.collect_set("source")).alias("seeds"))
    return distill.seed_table(groups)


@query("""
    SELECT event_id, '[backend=openrouter model=m/' || event_type || ' mode=wargame-vision images=' || event_id % 3 || ' latency_ms=' || event_id || CASE WHEN event_id % 2 = 0 AND value <> 0 THEN ' cost_usd=$' || printf('%.4f', value) ELSE '' END || ']' AS header,
           CASE WHEN event_id % 3 = 0 THEN 0.25::DOUBLE WHEN value = 0 THEN NULL ELSE value END AS cost FROM events""")
def provenance(spark, load):
    e = load("events")
    header = T.provenance_header(F.concat(F.lit("m/"), F.col("event_type")), F.col("event_id") % 3, "event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")))
    return e.select("event_id", header.alias("header"), V.response_cost(F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")), F.when(F.col("event_id") % 3 == 0, 0.25)).alias("cost"))


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '# State' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || text AS prompt, CASE WHEN turn % 3 = 0 THEN 'system: be brief / user: ' ELSE 'user: ' END || text AS messages,
           CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS blocks, 'base' || ' role' || turn AS system, CASE WHEN turn % 3 = 0 AND turn % 2 = 1 THEN 'system text without marker' WHEN turn % 3 <> 0 AND turn % 2 = 0 THEN 'system marker without system text' END AS error FROM conversations""")
def prompt_assembly(spark, load):
    c = load("conversations")
    system = F.when(F.col("turn") % 3 == 0, F.lit("be brief"))
    state = F.when(F.col("turn") % 2 == 0, F.lit("# State"))
    prompt = T.join_blocks(state, F.lit(""), F.col("text"))
    chat = T.messages("text", system=system)
    content = T.multimodal("text", F.when(F.col("turn") % 2 == 0, F.array(F.lit("data:image/png;base64,AA=="))))
    return c.select(
        "conv_id", "turn", prompt.alias("prompt"), F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " / ").alias("messages"), F.size(content).alias("blocks"),
        T.system_prompt(F.lit("base"), F.concat(F.lit(" role"), F.col("turn").cast("string"))).alias("system"), T.system_error(T.join_blocks(F.when(F.col("turn") % 2 == 0, F.lit("<<SYSTEM>>")), F.lit("ask")), "<<SYSTEM>>", system).alias("error"),
    )


@query("""
    SELECT p_partkey, CAST(floor((p_size * 61 * 3 // 8) * 4.0::DOUBLE / 60) AS BIGINT) AS minutes, CASE WHEN p_size % 3 <> 0 AND p_size % 5 <> 0 THEN CAST(p_size % 5 - p_size % 3 AS DOUBLE) END AS delta, CAST(p_size AS BIGINT) AS calls, p_size * 0.5::DOUBLE AS cost_usd,
           p_size * 75.0::DOUBLE / 20 / 60 AS plan_minutes, CAST(round(4180 + p_size / 4.0::DOUBLE) AS BIGINT) AS tokens FROM part""")
def estimates(spark, load):
    n = F.col("p_size").cast("long")
    rows = load("part").select("p_partkey", V.training_minutes(n * 61, 3, 2, 4, "unsloth").alias("minutes"), V.vram_delta((n % 3).cast("double"), (n % 5).cast("double")).alias("delta"), V.plan_estimate(n, 0.5, 75.0, 20).alias("plan"), V.ui_estimate(n).alias("ui"))
    return rows.select("p_partkey", "minutes", "delta", "plan.calls", "plan.cost_usd", F.col("plan.minutes").alias("plan_minutes"), "ui.tokens")


@query("""
    SELECT doc_id, array_to_string(list_sort(list_distinct([CAST(doc_id % 4 AS INT), CAST(doc_id % 3 AS INT), 7])), ',') AS ids FROM documents""")
def corpus_ids(spark, load):
    heading = lambda c: F.concat(F.lit("\n## Reference: corpus #"), c.cast("string"), F.lit("\ntext corpus #99\n"))
    d = load("documents").withColumn("prompt", F.concat(*(heading(c) for c in (F.col("doc_id") % 4, F.lit(7), F.col("doc_id") % 3, F.lit(7)))))
    return d.select("doc_id", F.array_join(T.corpus_ids("prompt"), ",").alias("ids"))


@query("""
    WITH q AS (SELECT doc_id AS seq, source AS template, 'T' || lang AS timestamp, CASE WHEN doc_id % 7 = 0 THEN 'contract pre-flight ' ELSE '' END || lang AS query FROM documents)
    SELECT seq, timestamp, query FROM q WHERE template = (SELECT min(source) FROM documents) AND NOT starts_with(coalesce(query, ''), 'contract pre-flight') AND timestamp IS DISTINCT FROM 'Ten' ORDER BY coalesce(timestamp, '') DESC, seq LIMIT 20""")
def recent_queries(spark, load):
    d = load("documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("template"), F.concat(F.lit("T"), F.col("lang")).alias("timestamp"), F.concat(F.when(F.col("doc_id") % 7 == 0, "contract pre-flight ").otherwise(""), F.col("lang")).alias("query"))
    first = d.agg(F.min("template").alias("t"))
    own = d.join(F.broadcast(first), F.col("template") == F.col("t"), "left_semi").withColumn("template", F.lit("x"))
    return relevance.recent_queries(own, "x", 20, exclude_timestamp="Ten").select("seq", "timestamp", "query")


@query("""
    SELECT conv_id, turn, '### T' || turn || ' — template:' || role || ' — shared corpus IDs: [' || CASE WHEN turn % 2 = 0 THEN '2' ELSE '' END || ']' || chr(10) || chr(10) || '**Prior query:** ' || CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END
           || chr(10) || chr(10) || '**Prior response (excerpt):** ok' || chr(10) || chr(10) AS quoted FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)""")
def preamble_entries(spark, load):
    c = load("conversations").select("conv_id", "turn", F.concat(F.lit("T"), F.col("turn").cast("string")).alias("timestamp"), F.col("role").alias("template"), F.col("text").alias("query"), F.lit(" ok ").alias("response"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("02"), F.lit("9"))).alias("retrieved_corpus_ids"))
    return c.select("conv_id", "turn", relevance.entry_text([1, 2]).alias("quoted"))


@query("SELECT o_orderkey, greatest(0, 3500 - o_orderkey % 5000) AS budget FROM orders")
def preamble_budget(spark, load):
    return load("orders").select("o_orderkey", relevance.preamble_budget(3500, F.col("o_orderkey") % 5000).alias("budget"))


@query("SELECT doc_id, CASE WHEN n_chars // 4 > 1000 THEN 'preamble token cap exceeded (' || n_chars // 4 || ' > 1000)' END AS error, CASE WHEN n_chars // 4 <= 1000 THEN n_chars // 4 END AS tokens FROM documents")
def token_cap(spark, load):
    counted = load("documents").select("doc_id", F.floor(F.col("n_chars") / 4).cast("long").alias("n")).withColumn("error", T.cap_error("n", 1000))
    return counted.select("doc_id", "error", F.when(F.col("error").isNull(), T.within_cap("n", 1000)).alias("tokens"))


@query("""SELECT i.item_id AS idx, CASE WHEN d.doc_id IS NOT NULL AND d.doc_id % 3 <> 1 THEN '{"idx":' || i.item_id || ',"response":' || CASE WHEN d.doc_id % 3 = 0 THEN 'null' ELSE '"' || d.lang || '/' || d.source || '"' END || ',"n_chars":' || d.n_chars || '}' ELSE '{}' END AS row
    FROM benchmark i LEFT JOIN documents d ON d.doc_id = i.item_id * 7""")
def results_by_index(spark, load):
    prompts = load("benchmark").select(F.col("item_id").alias("idx"))
    answer = F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit("/"), "source"))
    results = load("documents").where("doc_id % 7 = 0 AND doc_id % 3 <> 1").select(F.expr("doc_id div 7").alias("idx"), answer.alias("response"), "n_chars")
    return evaluate.results_json(prompts, results)


@query("""
    SELECT u.conv_id AS idx, u.turn, u.text AS query, a.text AS response_b FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user' AND u.turn % 5 <> 1 AND u.conv_id % 3 <> 0 AND u.text <> '' AND a.text <> '' AND a.conv_id % 4 <> 1""")
def judged_pairs(spark, load):
    """The answers of two runs: each lacks prompts that the other has, and one has empty answers."""
    side = lambda role, shift, response: load("conversations").where(F.col("role") == role).select(F.struct("conv_id", (F.col("turn") - shift).alias("turn")).alias("idx"), F.col("text").alias("query"), (F.col("turn") % 5 == 1).alias("is_forgetting"), response.alias("response"))
    a = side("user", 0, F.col("text")).where("idx.conv_id % 3 <> 0")
    b = side("assistant", 1, F.when(F.col("conv_id") % 4 == 1, "").otherwise(F.col("text"))).withColumn("is_forgetting", F.lit(None).cast("boolean"))
    return evaluate.judged_pairs(a, b).select(F.col("idx.conv_id").alias("idx"), "idx.turn", "query", "response_b")


@query("""
    SELECT p_partkey, CASE WHEN abs(p_size - 25) <= 5 THEN 'equal' WHEN p_size > 25 THEN 'first' ELSE 'second' END AS cause, round(p_retailprice, 1) AS shown FROM part""")
def attribution(spark, load):
    return load("part").select("p_partkey", evaluate.attribution(F.col("p_size"), F.lit(25), near=5).alias("cause"), V.rounded(F.col("p_retailprice"), 1).alias("shown"))


@query("""
    SELECT doc_id AS idx, FALSE AS is_forgetting FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40) UNION ALL SELECT item_id, TRUE FROM benchmark""")
def evaluation_prompts(spark, load):
    return distill.tagged_union(load("documents").select(F.col("doc_id").alias("idx")), load("benchmark").select(F.col("item_id").alias("idx")), 40).select("idx", "is_forgetting")


@query("SELECT doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_files_check(spark, load):
    return missing_files(load("documents").select(F.col("doc_id").alias("name")), load("labels").select(F.col("doc_id").alias("name")))


@query("SELECT c_custkey AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'other' ELSE c_name END AS name FROM customer UNION ALL SELECT c_custkey * 2 + 1000000, 'other' FROM customer WHERE c_custkey % 2 = 0")
def replace_or_insert(spark, load):
    old = load("customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"))
    even = old.where("slug % 2 = 0").select("slug", F.lit("other").alias("name"))
    return sinks.replace_or_insert(old, even.unionByName(even.select((F.col("slug") * 2 + 1_000_000).alias("slug"), "name")))


@query("""
    SELECT CAST(user_id AS VARCHAR) AS slug, CASE WHEN user_id % 2 = 0 THEN 'Named' ELSE CAST(user_id AS VARCHAR) END AS name, CASE WHEN user_id % 5 = 0 THEN 1.5::DOUBLE ELSE 0.0 END AS spend, 25.0::DOUBLE AS spend_budget, 'm' AS model, '' AS started,
           coalesce(max(CASE WHEN user_id % 3 <> 0 THEN event_id END), 0) AS turn FROM events GROUP BY user_id""")
def campaign_summaries(spark, load):
    e = load("events")
    none = lambda kind: F.lit(None).cast(kind)
    c = e.select(F.col("user_id").cast("string").alias("slug"), F.when(F.col("user_id") % 2 == 0, "Named").alias("name"), none("string").alias("started"), F.when(F.col("user_id") % 5 == 0, 1.5).alias("spend"), none("double").alias("spend_budget"), none("string").alias("model"))
    return campaign.summary(c.distinct(), e.where("user_id % 3 <> 0").select(F.col("user_id").cast("string").alias("slug"), F.col("event_id").alias("turn")), 25.0, "m")


@query("""
    SELECT item_id, '## ' || item_id || '.0 Start' || chr(10) || chr(10) || 'a' || chr(10) || '### ' || item_id || '.1 Move' || chr(10) || chr(10) || '#### ' || item_id || '.1.2 Roads' || chr(10) || chr(10) || '### ' || item_id || '.1a Note' || chr(10) || chr(10)
           || '### ' || item_id || '.2.3.4 Deep' || chr(10) || chr(10) || '**' || item_id || 'x bold**' || chr(10) || chr(10) || 'tail' AS md FROM benchmark""")
def picture_headings(spark, load):
    block = lambda s: F.concat(F.lit("**----- Start of picture text -----**<br>\n"), s, F.lit("<br>**----- End of picture text -----**<br>\n"))
    n = F.col("item_id").cast("string")
    part = lambda tail: block(F.concat(n, F.lit(tail)))
    md = F.concat(part(".0 Start "), F.lit("a\n"), part(".1 Move"), part(".1.2 Roads"), part(".1a Note"), part(".2.3.4 Deep"), part("x bold"), F.lit("tail"))
    return load("benchmark").select("item_id", documents.promote_picture_text(md).alias("md"))


@query("""
    SELECT item_id, 'one two; ' || item_id || ' more; last' AS items, 'new ' || item_id AS intent FROM benchmark""")
def order_bullets(spark, load):
    n = F.col("item_id").cast("string")
    md = F.concat(F.lit("## What I see on the board\n- one\n  two\n* "), n, F.lit("\n\nmore\n+ last\n## Intent\nold\n## INTENT\nnew "), n, F.lit("\n"))
    parsed = orders.parse(load("benchmark").withColumn("md", md))
    return parsed.select("item_id", F.array_join("orders.see_board", "; ").alias("items"), orders.intent().alias("intent"))


@query("""
    WITH c AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
    SELECT 'r' || n_regionkey AS workbook, '### r' || n_regionkey || chr(10) || chr(10) || '#### sheet: nations' || chr(10) || chr(10) || '| key | name |' || chr(10) || '|---|---|' || chr(10)
           || string_agg('| ' || n_nationkey || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || '#### sheet: notes' || chr(10) || chr(10) || '_(empty)_' AS markdown FROM c GROUP BY n_regionkey""")
def sheet_tables(spark, load):
    n = load("nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("workbook"), F.col("n_nationkey").cast("int").alias("k"), "n_name")
    body = n.select("workbook", F.lit(0).alias("sheet_no"), F.lit("nations").alias("sheet"), (F.col("k") + 1).alias("row_no"), F.array(F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, F.col("n_name")), F.lit("cut")).alias("cells"))
    books = n.select("workbook").distinct()
    head = books.select("workbook", F.lit(0).alias("sheet_no"), F.lit("nations").alias("sheet"), F.lit(0).alias("row_no"), F.array(F.lit("key"), F.lit("name")).alias("cells"))
    empty = books.select("workbook", F.lit(1).alias("sheet_no"), F.lit("notes").alias("sheet"), F.lit(None).cast("int").alias("row_no"), F.lit(None).cast("array<string>").alias("cells"))
    return readers.sheet_markdown(body.unionByName(head).unionByName(empty))


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '# error: empty stdout' || chr(10) || chr(10) || '## stdout' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || '## stderr' || chr(10) || chr(10) || event_type || chr(10)
           ELSE '# error: missing or malformed header line in stderr' || chr(10) || chr(10) || '## stdout' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '## stderr' || chr(10) || chr(10) || event_type || chr(10) END AS text FROM events""")
def quarantined(spark, load):
    e = load("events").select("event_id", F.when(F.col("event_id") % 2 == 0, " ").otherwise("x").alias("stdout"), F.col("event_type").alias("stderr"))
    return sinks.quarantine(e.withColumn("checked", T.validated("stdout", "stderr")))[1].select("event_id", "text")


@query("""
    SELECT event_id, chr(10) || '## Turn ' || event_id || ' — T (model: m)' || chr(10) || chr(10) || '**Status:** ok' || chr(10) || chr(10) || '**Intent:** ' || event_type || chr(10) || chr(10) || '**Orders (verbatim):**' || chr(10) || chr(10) || '> a' || chr(10) || '> ' || event_type
           || chr(10) || chr(10) || '---' || chr(10) AS section, CAST(event_id % 3 AS VARCHAR) || ',' || event_type AS newest FROM events""")
def turn_narratives(spark, load):
    e = load("events")
    section = sinks.turn_narrative(F.col("event_id"), F.lit("T"), F.lit("m"), F.lit("ok"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")), F.concat(F.lit("\na\n"), F.col("event_type"), F.lit("\n")))
    return e.select("event_id", section.alias("section"), F.array_join(V.newest_first(F.array(F.lit("x"), F.col("event_type"), (F.col("event_id") % 3).cast("string")), 2), ",").alias("newest"))


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS slug, 'root/' || c_custkey AS dir, c_custkey = 5 AS is_example FROM customer WHERE c_custkey % 2 = 1""")
def campaign_folders(spark, load):
    c = load("customer").select(F.col("c_custkey").alias("k"))
    found = c.select(F.concat(F.lit("root/"), F.col("k").cast("string"), F.lit("/"), F.when(F.col("k") % 2 == 1, "MISSION.md").otherwise("x.md")).alias("path"), F.when(F.col("k") % 2 == 1, "MISSION.md").otherwise("x.md").alias("name"))
    return readers.campaigns(found, "5")


@query("""
    WITH c AS (SELECT c_nationkey AS project, count(*) AS n, min(c_acctbal) AS least, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey)
    SELECT project, n % 2 = 0 AND least >= -900 AND segments >= 5 AS ok, array_to_string(list_filter([CASE WHEN n % 2 <> 0 THEN 'even' END, CASE WHEN least < -900 THEN 'solvent' END, CASE WHEN segments < 5 THEN 'segments' END], lambda x: x IS NOT NULL), ',') AS issues FROM c""")
def health(spark, load):
    """Three checks of every nation's customers; each fails for some."""
    c = load("customer").groupBy(F.col("c_nationkey").alias("project")).agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("least"), F.countDistinct("c_mktsegment").alias("segments"))
    check = lambda place, name, value: F.struct(F.lit(place).alias("place"), F.lit(name).alias("name"), value.alias("value"))
    checks = F.array(check(0, "even", (F.col("n") % 2 == 0).cast("string")), check(1, "solvent", F.when(F.col("least") < -900, F.concat(F.lit("missing "), (-F.col("least")).cast("string"))).otherwise("ok")), check(2, "segments", (F.col("segments") >= 5).cast("string")))
    return campaign.health_of(c.select("project", F.explode(checks).alias("c")).select("project", "c.*")).select("project", "ok", F.array_join("issues", ",").alias("issues"))


@query("""
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations),
    c AS (SELECT conv_id, count(*) AS n, '# Log' || chr(10) || string_agg('## Turn ' || turn || chr(10) || text || chr(10), '' ORDER BY turn DESC) AS full_text, '# Log' || chr(10) || string_agg('## Turn ' || turn || chr(10) || text || chr(10), '' ORDER BY turn DESC) FILTER (k <= 3) AS head,
                 string_agg('### rules/b' || turn || CASE WHEN turn % 4 = 1 THEN '.digest.md' || chr(10) || chr(10) || left(text, 50) ELSE '.md' || chr(10) || chr(10) || text END || chr(10), chr(10) ORDER BY 'b' || turn || '.md') FILTER (role = 'assistant') AS books FROM t GROUP BY conv_id)
    SELECT conv_id AS project, md5(array_to_string(list_filter([CASE WHEN conv_id % 3 <> 0 THEN '### MISSION.md' || chr(10) || chr(10) || 'mission ' || conv_id || chr(10) END,
        CASE WHEN conv_id % 4 > 1 THEN '### tasks.json' || chr(10) || chr(10) || '```json' || chr(10) || '{' || chr(10) || '  "turns": [' || chr(10) || '    ' || n || chr(10) || '  ]' || chr(10) || '}' || chr(10) || '```' || chr(10) END,
        '### turn-log.md' || chr(10) || chr(10) || CASE WHEN n <= 3 THEN full_text ELSE regexp_replace(head, '\\s+$', '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '_(' || (n - 3) || ' earlier turn(s) omitted from preamble; full history in turn-log.md)_' || chr(10) END || chr(10), books], lambda x: x IS NOT NULL), chr(10))) AS digest FROM c""")
def project_context(spark, load):
    """A project per conversation: mission and tasks where there are any (some tasks are no JSON), its turns as the log, answers as rule books, some with digests."""
    t = load("conversations")
    turn = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"))
    log = F.concat(F.lit("# Log\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t"))), asc=False), lambda x: x["t"]), ""))
    c = t.groupBy(F.col("conv_id").alias("project")).agg(F.count(F.lit(1)).alias("n"), log.alias("turn_log"))
    tasks = F.when(F.col("project") % 4 == 0, "{no json").when(F.col("project") % 4 > 1, F.format_string('{"turns":[%d]}', "n"))
    projects = c.select("project", F.when(F.col("project") % 3 != 0, F.concat(F.lit("mission "), F.col("project").cast("string"))).alias("mission"), tasks.alias("tasks"), "turn_log")
    books = t.where("role = 'assistant'").select(F.col("conv_id").alias("project"), F.concat(F.lit("b"), F.col("turn").cast("string")).alias("stem"), "turn", "text")
    rules = books.select("project", F.concat("stem", F.lit(".md")).alias("name"), "text").unionByName(books.where("turn % 4 = 1").select("project", F.concat("stem", F.lit(".digest.md")).alias("name"), F.left("text", F.lit(50)).alias("text")))
    return documents.project_contexts(projects, rules).select("project", F.md5("context").alias("digest"))
