"""Driver queries: the library's operators over the driver's tables, each beside its SQL.

The tables stand in for the logs: events for calls and metrics (event_id is the order, value the cost, props.k a payload),
documents for entries and rule books, conversations for queries and responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions import text as T
from calltide.functions import values as V
from calltide.operators import calls, campaign, distill, documents, evaluate, gates, orders, relevance
from calltide.session import ship
from calltide.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Markers that occur in the invented prose; the vocabularies of the library are parameters.
MARKERS = ("the ", "tion", "über", "ción", "eaux", "ing ", "anes", "keit")
LEAKS = ("thst", "ñ", "ü")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function (spark, load) under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits(markers, column: str = "text") -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{m}') AS INT)" for m in markers) + ")"


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN}')), lambda x: NOT list_contains({_quoted(T.STOP_WORDS)}, x))"


def _moment(rows: DataFrame) -> list[str]:
    """``now`` where the rows have it."""
    return [c for c in rows.columns if c == "now"]


def _k(events: DataFrame) -> Column:
    return F.try_variant_get(F.try_parse_json("props"), "$.k", "int")


def _metrics(events: DataFrame) -> DataFrame:
    k = _k(events)
    rows = events.where(F.col("event_type") == "purchase")
    return rows.select(*_moment(rows), F.col("event_id").alias("seq"), "ts", F.col("value").alias("cost_usd"), (k % 2 == 0).alias("conclusion_changed"), (k * F.lit(0.001)).alias("maintenance_hours"))


def _baseline(events: DataFrame) -> DataFrame:
    return events.select(*_moment(events), "ts", F.col("value").alias("cost_usd"))


def _with(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row."""
    return rows.join(F.broadcast(one))


def _timed(events: DataFrame) -> DataFrame:
    """Events with ``now``, the latest time of all."""
    return _with(events, events.agg(F.max("ts").alias("now")))


_GATES = f"""
    WITH m AS (SELECT event_id AS seq, ts, value AS cost, {_K} AS k FROM events WHERE event_type = 'purchase'),
    w AS (SELECT max(ts) - INTERVAL 7 DAYS AS cutoff FROM events),
    hp AS (SELECT count(*) AS n, CAST(sum(CAST(cost AS DECIMAL(28,8))) AS DOUBLE) / count(cost) AS a FROM m, w WHERE ts >= cutoff),
    base AS (SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,8))) AS DOUBLE) / count(value) AS a FROM events, w WHERE ts >= cutoff),
    c AS (SELECT hp.n AS wrapped_calls, hp.a AS wrapped_avg, base.n AS baseline_calls, base.a AS baseline_avg, CASE WHEN hp.a <> 0 AND base.a > 0 THEN hp.a / base.a END AS ratio FROM hp, base),
    cost AS (SELECT *, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio > 1.5 THEN 'abort' WHEN ratio > 1.35 THEN 'warn' ELSE 'ok' END AS ratio_status FROM c),
    l AS (SELECT count(*) AS last_rows, count(*) FILTER (k % 2 = 0) AS flagged FROM (SELECT * FROM m ORDER BY seq DESC LIMIT 5)),
    flags AS (SELECT *, CASE WHEN last_rows < 5 THEN 'unknown' WHEN flagged < 2 THEN 'abort' WHEN flagged = 2 THEN 'warn' ELSE 'ok' END AS flag_status FROM l),
    h AS (SELECT coalesce(CAST(sum(CAST(k * 0.001 AS DECIMAL(28,8))) AS DOUBLE), 0) AS hours FROM m, w WHERE ts >= cutoff),
    used AS (SELECT *, CASE WHEN hours > 2.0 THEN 'abort' WHEN hours > 1.8 THEN 'warn' ELSE 'ok' END AS hours_status FROM h)
"""


@query(_GATES + "SELECT * FROM cost")
def gate_cost_ratio(spark, load):
    e = _timed(load("events"))
    return gates.cost_ratio(_metrics(e), _baseline(e), F.col("now"))


@query(_GATES + "SELECT * FROM flags")
def gate_last_n(spark, load):
    return gates.last_flags(_metrics(load("events")))


@query(_GATES + "SELECT * FROM used")
def gate_budget_sum(spark, load):
    return gates.hours_used(_metrics(_timed(load("events"))), F.col("now"))


@query(
    _GATES
    + """, g AS (SELECT *, list_filter(['cost_ratio:' || ratio_status, 'conclusion_changed:' || flag_status, 'maintenance_hours:' || hours_status], lambda x: NOT ends_with(x, ':ok')) AS bad FROM cost, flags, used)
    SELECT CASE WHEN len(list_filter(bad, lambda x: ends_with(x, ':abort'))) > 0 THEN 'ABORT' WHEN len(bad) > 0 THEN 'EXTEND' ELSE 'CONTINUE' END AS verdict,
           CASE WHEN len(list_filter(bad, lambda x: ends_with(x, ':abort'))) > 0 THEN 2 WHEN len(bad) > 0 THEN 1 ELSE 0 END AS exit_code,
           wrapped_calls, baseline_calls, ratio, flagged, hours, coalesce(array_to_string(list_transform(list_filter(bad, lambda x: ends_with(x, ':abort')), lambda x: string_split(x, ':')[1]), ','), '') AS issues,
           coalesce(array_to_string(list_transform(list_filter(bad, lambda x: NOT ends_with(x, ':abort')), lambda x: string_split(x, ':')[1]), ','), '') AS warnings FROM g"""
)
def gate_verdict(spark, load):
    e = _timed(load("events"))
    one = gates.verdict(_metrics(e), _baseline(e), F.col("now"))
    return one.select("verdict", "exit_code", "wrapped_calls", "baseline_calls", "ratio", "flagged", "hours", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"))


def _calls(e: DataFrame) -> DataFrame:
    k, vision = _k(e), F.col("event_type") == "signup"
    none = lambda kind: F.lit(None).cast(kind)
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("timestamp"), F.when(vision, "wargame-vision").alias("mode"), F.lit("q").alias("query"), none("string").alias("response"),
        F.when(F.col("event_type").isin("signup", "error"), None).otherwise(F.col("event_type")).alias("template"), F.when((F.col("event_type") == "error") & (k % 2 == 1), F.array(F.lit("template"))).alias("nulls"), F.when(vision, F.lit("m/vision")).alias("model"), F.when(k % 3 != 0, k).otherwise(0).alias("preamble_tokens"), (k + 1).alias("preamble_text_tokens"),
        F.when(k % 2 == 0, F.col("value")).alias("cost_usd"), F.when(k % 7 == 0, 0.5).alias("usage_cost"), (F.col("event_id") * 3).alias("latency_ms"), none("bigint").alias("wrapper_elapsed_ms"),
        F.when(k % 4 == 0, F.array(k, F.lit(7))).alias("new_query_corpus_ids"), none("array<int>").alias("matched_prior_corpus_ids"), none("bigint").alias("injected_prior_count"), none("string").alias("state_dir"),
        F.when(vision, F.array(F.lit("a.png"))).alias("images"), none("array<string>").alias("xlsx"),
    )


def _call_metrics(e: DataFrame) -> DataFrame:
    k = _k(e)
    return e.where(F.col("event_type") == "click").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("timestamp"), k.alias("preamble_tokens"), F.when(k % 5 != 0, F.col("value")).alias("cost_usd"), (k % 2 == 0).alias("conclusion_changed"),
        (k % 3).alias("exit_code"), k.cast("bigint").alias("image_count"), F.lit(None).cast("bigint").alias("xlsx_count"),
    )


@query(f"""
    WITH c AS (SELECT *, {_K} AS k FROM events),
    m AS (SELECT user_id, max_by(k, event_id) AS k, max_by(value, event_id) AS value FROM c WHERE event_type = 'click' GROUP BY user_id)
    SELECT c.event_id AS seq, CAST(c.user_id AS VARCHAR) AS timestamp, CASE WHEN event_type = 'signup' THEN 'vision' ELSE 'audit' END AS kind,
           CASE WHEN event_type = 'signup' THEN 'm/vision' WHEN event_type = 'error' AND c.k % 2 = 1 THEN NULL WHEN event_type = 'error' THEN '' ELSE event_type END AS label,
           'q' AS query, '' AS response, event_id * 3 AS latency_ms, CAST(NULL AS BIGINT) AS wrapper_elapsed_ms, CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type END AS template,
           CASE WHEN c.k % 4 = 0 THEN c.k || ',7' ELSE '' END AS new_query_corpus_ids, '' AS matched_prior_corpus_ids, CAST(NULL AS BIGINT) AS injected_prior_count, CASE WHEN event_type = 'signup' THEN 'm/vision' END AS model,
           CAST(NULL AS VARCHAR) AS state_dir, CASE WHEN event_type = 'signup' THEN 'a.png' ELSE '' END AS images, '' AS xlsx, CAST(m.k AS BIGINT) AS image_count, CAST(NULL AS BIGINT) AS xlsx_count,
           coalesce(nullif(CASE WHEN event_type = 'signup' THEN c.k + 1 WHEN c.k % 3 <> 0 THEN c.k ELSE 0 END, 0), nullif(m.k, 0), 0) AS tokens,
           coalesce(CASE WHEN c.k % 2 = 0 THEN c.value END, CASE WHEN m.k % 5 <> 0 THEN m.value END, CASE WHEN c.k % 7 = 0 THEN 0.5 END) AS cost_usd, m.k % 2 = 0 AS conclusion_changed, m.k % 3 AS exit_code
    FROM c LEFT JOIN m USING (user_id)""")
def calls_normalized(spark, load):
    e = load("events")
    listed = {c: F.array_join(c, ",") for c in ("new_query_corpus_ids", "matched_prior_corpus_ids", "images", "xlsx")}
    return calls.load(_calls(e), _call_metrics(e)).withColumns(listed)


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100 OFFSET 50")
def calls_page(spark, load):
    return calls.page(load("events").select("event_id", "user_id", "event_type", "value"), 100, 50, seq="event_id")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id")
def calls_sorted_nulls_last(spark, load):
    joined = load("documents").select("doc_id").join(load("labels").select("doc_id", "quality"), "doc_id", "left")
    return calls.sort(joined, "quality", descending=False, ties=("doc_id",))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'licens') OR contains(lower(source), 'licens')")
def calls_search(spark, load):
    return calls.search(load("documents"), "LICENS", ("text", "source")).select("doc_id", "lang")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY event_id LIMIT 1")
def call_lookup(spark, load):
    e = load("events")
    return calls.lookup(_with(e, e.agg(F.min("user_id").alias("asked"))), F.col("asked"), "user_id", "event_id").select("event_id", "event_type", "value")


@query("SELECT doc_id, quality, CASE WHEN doc_id = (SELECT min(doc_id) FROM labels) THEN NULL ELSE toxic = 1 END AS toxic FROM labels")
def flag_update(spark, load):
    rows = load("labels").withColumn("toxic", F.col("toxic") == 1)
    return sinks.with_flag(_with(rows, rows.agg(F.min("doc_id").alias("asked"))), F.col("asked"), None, "doc_id", "toxic").select("doc_id", "quality", "toxic")


@query("SELECT CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS INT) AS log, event_id AS seq, event_type, CASE WHEN event_type = 'click' THEN value END AS value FROM events WHERE event_type IN ('click', 'view')")
def log_union(spark, load):
    e = load("events").withColumnRenamed("event_id", "seq")
    both = calls.union_logs(e.where("event_type = 'click'").select("seq", "event_type", "value"), e.where("event_type = 'view'").select("seq", "event_type"))
    return both.select("seq.log", "seq.seq", "event_type", "value")


@query(f"SELECT event_id, CAST({_K} AS DOUBLE) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_field_extract(spark, load):
    v = load("events").select("event_id", F.try_parse_json("props").alias("v"))
    return v.select("event_id", readers.number_field("k"), readers.field("missing", "string"))


@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(list_sort(t), ',')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tokenize(spark, load):
    return load("documents").select("doc_id", T.tokens("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join(F.sort_array("t"), ",")).alias("digest"))


@query(f"SELECT token, count(*) AS df FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token")
def token_document_frequency(spark, load):
    return relevance.document_frequency(load("documents"), "text")


@query(f"SELECT token, count(*) AS df FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) / (SELECT count(*) FROM documents) < 0.1")
def rare_tokens(spark, load):
    return relevance.rare_tokens(load("documents"), "text")


_RELEVANCE = f"""
    WITH e AS (SELECT doc_id, doc_id % 50 AS age, unnest({_TOKENS}) AS token FROM documents), q AS (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark),
    rare AS (SELECT token FROM e GROUP BY token HAVING count(*) / (SELECT count(*) FROM documents) < 0.1),
    o AS (SELECT item_id, doc_id, any_value(age) AS age, count(*) AS n FROM q JOIN rare USING (token) JOIN e USING (token) GROUP BY item_id, doc_id),
    s AS (SELECT item_id, doc_id, n * greatest(0.0::DOUBLE, 1.0::DOUBLE - age / 30.0::DOUBLE) AS score FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 2)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 3"""


@query(_RELEVANCE)
def relevance_topk(spark, load):
    return relevance.rank(load("benchmark"), load("documents"), "item_id", "text", "doc_id", "text", F.col("doc_id") % 50, min_score=2.0)


@query(f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents)
    SELECT a.doc_id, len(list_intersect(a.t, b.t)) AS overlap FROM d a, (SELECT t FROM d ORDER BY doc_id LIMIT 1) b WHERE len(list_intersect(a.t, b.t)) > 0""")
def token_overlap(spark, load):
    d = load("documents").select("doc_id", "text")
    one = d.orderBy("doc_id").limit(1).withColumnRenamed("doc_id", "q")
    return relevance.overlaps(one, d, "q", "text", "doc_id", "text").select("doc_id", "overlap")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, running_cost FROM (SELECT l_orderkey, l_linenumber, l_partkey, sum(CAST(l_quantity AS BIGINT)) OVER
    (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running_cost FROM lineitem) WHERE running_cost <= 60""")
def budget_prefix(spark, load):
    rows = relevance.budget_prefix(load("lineitem"), F.col("l_quantity").cast("bigint"), 60, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_orderkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "running_cost")


@query(f"SELECT doc_id, {_hits(MARKERS)} AS hits FROM documents")
def marker_hits(spark, load):
    return load("documents").select("doc_id", T.marker_hits("text", MARKERS).alias("hits"))


@query(f"SELECT doc_id, least({_hits(MARKERS)} / 4.0::DOUBLE, 1.0::DOUBLE) AS score FROM documents")
def structural_score(spark, load):
    return load("documents").select("doc_id", T.capped_score("text", MARKERS).alias("score"))


@query(f"SELECT conv_id, turn FROM conversations WHERE {_hits(MARKERS)} >= 2 AND length(text) >= 200")
def quality_filter(spark, load):
    return load("conversations").where(T.passes_quality("text", MARKERS)).select("conv_id", "turn")


@query(f"SELECT conv_id, turn FROM conversations WHERE {_hits(LEAKS)} = 0 AND length(text) >= 30")
def anti_leakage_filter(spark, load):
    return load("conversations").where(T.passes_anti_leakage("text", LEAKS)).select("conv_id", "turn")


@query(f"SELECT source, lang, sum(least({_hits(MARKERS)} / 4.0::DOUBLE, 1.0::DOUBLE)) / count(*) AS mean_score, sum({_hits(MARKERS)}) / count(*) AS mean_hits, count(*) AS n FROM documents GROUP BY source, lang")
def condition_means(spark, load):
    return evaluate.condition_means(load("documents"), ["source", "lang"], "text", MARKERS)


_VARIANTS, _CONDITIONS = ("src0", "src3", "src5"), ("en", "de", "fr", "es", "xx")
_PIVOT = f"""
    WITH h AS (SELECT lang AS condition, source AS variant, {_hits(MARKERS)} AS hits FROM documents),
    p AS (SELECT CAST(k - 1 AS INT) AS position, c AS condition, """ + ", ".join(f"coalesce((SELECT sum(hits) / count(*) FROM h WHERE variant = '{v}' AND h.condition = c), 0.0) AS {v}" for v in _VARIANTS) + f"""
    FROM (SELECT unnest(range(1, 6)) AS k, unnest({_quoted(_CONDITIONS)}) AS c))"""


def _pivot(load) -> DataFrame:
    rows = load("documents").select(F.col("lang").alias("condition"), F.col("source").alias("variant"), F.col("text").alias("response"))
    return evaluate.condition_pivot(rows, _VARIANTS, _CONDITIONS, markers=MARKERS)


@query(_PIVOT + " SELECT *, src3 - src0 AS src3_delta, src5 - src0 AS src5_delta FROM p")
def condition_pivot(spark, load):
    return _pivot(load)


@query(_PIVOT + """, s AS (SELECT v AS variant, (SELECT s FROM (SELECT src0 AS s FROM p WHERE condition = 'en')) AS x, 0 AS k FROM (SELECT 'src0' AS v)),
    d AS (SELECT max(src0) FILTER (condition = 'en') - max(src0) FILTER (condition = 'de') AS a, max(src3) FILTER (condition = 'en') - max(src3) FILTER (condition = 'de') AS b, max(src5) FILTER (condition = 'en') - max(src5) FILTER (condition = 'de') AS c FROM p)
    SELECT unnest(['src0', 'src3', 'src5']) AS variant, unnest([round(a, 9), round(b, 9), round(c, 9)]) AS signal, unnest([0.0, round(b - a, 9), round(c - a, 9)]) AS versus_first FROM d""")
def adapter_signal(spark, load):
    return evaluate.adapter_signal(_pivot(load), _VARIANTS, "en", "de").select("variant", F.round("signal", 9).alias("signal"), F.round("versus_first", 9).alias("versus_first"))


@query(_PIVOT + """, d AS (SELECT src3 - src0 AS d3, src5 - src0 AS d5 FROM p WHERE condition = 'en'), b AS (SELECT CASE WHEN d5 > d3 THEN 'src5' ELSE 'src3' END AS winner, greatest(d3, d5) AS delta FROM d)
    SELECT winner, delta, CASE WHEN delta >= 0.5 THEN 'LAUNCH SWAP' WHEN delta > 0.1 THEN 'POST-LAUNCH FOLLOW-UP' WHEN abs(delta) <= 0.1 THEN 'NO-GO' ELSE 'REVERT' END AS decision FROM b""")
def best_variant(spark, load):
    one = _pivot(load).where("condition = 'en'")
    return evaluate.best_variant(one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("position"), F.lit(v).alias("variant"), F.col(f"{v}_delta").alias("delta")) for k, v in enumerate(_VARIANTS[1:]))))))


@query(f"""
    WITH m AS (SELECT CASE lang WHEN 'en' THEN 'gold' WHEN 'de' THEN 'student' WHEN 'fr' THEN 'ablation' ELSE 'vanilla' END AS c, least({_hits(MARKERS)} / 4.0::DOUBLE, 1.0::DOUBLE) AS s FROM documents),
    a AS (SELECT c, sum(s) / count(*) AS s FROM m GROUP BY c), o AS (SELECT max(s) FILTER (c = 'student') AS student, max(s) FILTER (c = 'gold') AS gold, max(s) FILTER (c = 'ablation') AS ablation FROM a)
    SELECT *, student / gold AS ratio, CASE WHEN student / gold >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS ratio_verdict,
           CASE WHEN abs(student - ablation) < 0.05 THEN 'NEAR TIE' WHEN student > ablation THEN 'ADAPTER WINS' ELSE 'PROMPT WINS' END AS adapter_verdict FROM o""")
def score_verdict(spark, load):
    condition = F.when(F.col("lang") == "en", "gold").when(F.col("lang") == "de", "student").when(F.col("lang") == "fr", "ablation").otherwise("vanilla")
    return evaluate.score_verdict(evaluate.condition_means(load("documents").withColumn("condition", condition), ["condition"], "text", MARKERS))


@query("""
    WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE role = 'user'),
    a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE role = 'assistant')
    SELECT u.conv_id, CAST(u.idx AS INT) AS idx, u.turn AS user_turn, a.turn AS assistant_turn FROM u JOIN a ON u.conv_id = a.conv_id AND u.idx = a.idx""")
def pairwise_zip_join(spark, load):
    c = load("conversations")
    side = lambda role: evaluate.with_index(c.where(F.col("role") == role), ["turn"], ["conv_id"]).select("conv_id", "idx", F.col("turn").alias(f"{role}_turn"))
    return evaluate.zip_join(side("user"), side("assistant"), ["conv_id", "idx"])


_RAW = "CASE WHEN turn % 5 = 0 THEN ' a.' WHEN turn % 5 = 1 THEN 'Tie' WHEN turn % 5 = 2 THEN 'I say response b' WHEN turn % 5 = 3 THEN 'B..' ELSE left(text, 12) END"
_VERDICT = f"""
    WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END AS slot, rtrim(trim(upper({_RAW})), '.') AS t FROM conversations),
    v AS (SELECT conv_id, turn, slot, CASE WHEN contains(t, 'TIE') THEN 'TIE' WHEN starts_with(t, 'A') OR contains(t, 'RESPONSE A') THEN 'A' WHEN starts_with(t, 'B') OR contains(t, 'RESPONSE B') THEN 'B' ELSE 'UNCLEAR' END AS verdict FROM r),
    o AS (SELECT *, CASE WHEN verdict = slot THEN 'candidate_wins' WHEN verdict = 'TIE' THEN 'tie' WHEN verdict = 'UNCLEAR' THEN 'unclear' ELSE 'baseline_wins' END AS outcome FROM v)
"""


def _judged(load) -> DataFrame:
    rows = load("conversations").withColumn("raw_judge", F.expr(_RAW)).withColumn("candidate_slot", F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B"))
    return evaluate.judge(rows)


@query(_VERDICT + "SELECT conv_id, turn, verdict, outcome FROM o")
def judge_parse(spark, load):
    return _judged(load).select("conv_id", "turn", "verdict", "outcome")


@query(_VERDICT + """, s AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'candidate_wins') AS candidate_wins, count(*) FILTER (outcome = 'baseline_wins') AS baseline_wins, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (outcome = 'unclear') AS unclear FROM o)
    SELECT *, candidate_wins / greatest(n - ties - unclear, 1) AS win_rate, CASE WHEN candidate_wins / greatest(n - ties - unclear, 1) > 0.55 THEN 'candidate' WHEN baseline_wins / greatest(n - ties - unclear, 1) > 0.55 THEN 'baseline' ELSE 'equal' END AS preferred FROM s""")
def judge_outcomes(spark, load):
    return evaluate.outcome_summary(_judged(load))


@query(_VERDICT + "SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def outcome_histogram(spark, load):
    return evaluate.histogram(_judged(load))


@query("WITH coin(idx, candidate_slot) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in evaluate.swap_slots(range(5000))) + ") SELECT item_id AS idx, candidate_slot FROM benchmark JOIN coin ON coin.idx = item_id")
def blind_swap(spark, load):
    ship(spark)
    return evaluate.with_slots(load("benchmark").select(F.col("item_id").alias("idx")))


@query("WITH b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'X' WHEN doc_id % 3 = 1 THEN 'x' ELSE ' ' END AS box FROM documents) SELECT count(*) AS total, count(*) FILTER (lower(box) = 'x') AS relevant, count(*) FILTER (lower(box) = 'x') / count(*) AS precision, CASE WHEN count(*) FILTER (lower(box) = 'x') / count(*) >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM b")
def precision_score(spark, load):
    sheet = F.concat(F.lit("Mark `[x]` below.\n\n- ["), F.when(F.col("doc_id") % 3 == 0, "X").when(F.col("doc_id") % 3 == 1, "x").otherwise(" "), F.lit("] **match 1."), F.col("doc_id").cast("string"), F.lit("** text\n"))
    return evaluate.precision(load("documents").select(F.explode(T.checkboxes(sheet)).alias("box")))


@query("SELECT r_name AS template, n_nationkey AS seed_idx, n_name AS seed, event_type AS domain FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT DISTINCT event_type FROM events)")
def seed_cross_join(spark, load):
    seeds = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("template"), F.col("n_nationkey").alias("seed_idx"), F.col("n_name").alias("seed"))
    return distill.expansion_tasks(seeds, load("events").select(F.col("event_type").alias("domain")).distinct())


@query("""
    WITH l AS (SELECT conv_id, turn, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT conv_id, turn, string_split('Q: ' || replace(text, chr(10), chr(10) || 'q. '), chr(10)) AS ls FROM conversations)),
    q AS (SELECT conv_id, turn, k, trim(regexp_extract(trim(line), '^[Qq][:.]\\s*(.+)', 1)) AS query FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS n FROM q WHERE length(query) > 20 AND length(query) < 300)
    SELECT conv_id, turn, CAST(n - 1 AS INT) AS place, query FROM r WHERE n <= 3""")
def q_line_parse(spark, load):
    text = F.concat(F.lit("Q: "), F.replace("text", F.lit("\n"), F.lit("\nq. ")))
    return load("conversations").select("conv_id", "turn", F.posexplode(T.question_lines(text, 20, 300, 3)).alias("place", "query"))


@query("SELECT u.conv_id, u.turn, 'user: ' || u.text || ' / assistant: ' || a.text AS messages FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def chat_format(spark, load):
    u, a = load("conversations").where("role = 'user'"), load("conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    chat = u.join(a, ["conv_id", "turn"]).withColumn("m", T.messages("text", "answer"))
    return chat.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), " / ").alias("messages"))


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents WHERE lang IN ('en', 'fr')")
def mix_union_shuffle(spark, load):
    d = load("documents").select("doc_id", "lang")
    return distill.mixed(d.where("lang = 'en'"), d.where("lang = 'fr'"), key="doc_id")


_LINES = "SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> '')"
_SHAPED = "trim(line) <> '' AND length(trim(line)) <= 60 AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '**==>') AND NOT starts_with(trim(line), '- ')"


@query(f"WITH l AS ({_LINES}) SELECT doc_id, trim(line) AS line, count(*) AS n FROM l WHERE {_SHAPED} GROUP BY doc_id, trim(line) HAVING count(*) >= 2")
def banner_lines(spark, load):
    return documents.banner_lines(load("documents"), "doc_id", "text", repeats=2)


@query(f"""
    WITH l AS ({_LINES}), b AS (SELECT doc_id, trim(line) AS banner FROM l WHERE {_SHAPED} GROUP BY ALL HAVING count(*) >= 2),
    k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY k) AS body FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND banner = trim(line)
          WHERE banner IS NULL AND NOT regexp_matches(trim(line), '^Page \\d+\\s*$|^\\d{{1,3}}\\s*$') GROUP BY l.doc_id)
    SELECT d.doc_id, md5(regexp_replace(regexp_replace(coalesce(body, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10)) AS digest FROM documents d LEFT JOIN k USING (doc_id) WHERE text IS NOT NULL""")
def cleanup_document(spark, load):
    return load("documents").where("text IS NOT NULL").select("doc_id", F.md5(documents.clean_markdown("text", repeats=2)).alias("digest"))


@query("""
    WITH c AS (SELECT conv_id, count(*) AS n, '# Log' || chr(10) || string_agg('## Turn ' || turn || chr(10) || text || chr(10), '' ORDER BY turn DESC) AS full_text,
                      '# Log' || chr(10) || string_agg('## Turn ' || turn || chr(10) || text || chr(10), '' ORDER BY turn DESC) FILTER (k <= 3) AS head
               FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) GROUP BY conv_id)
    SELECT conv_id, md5(CASE WHEN n <= 3 THEN full_text ELSE regexp_replace(head, '\\s+$', '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '_(' || (n - 3) || ' earlier turn(s) omitted from preamble; full history in turn-log.md)_' || chr(10) END) AS digest FROM c""")
def trim_sections(spark, load):
    turn = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"))
    logs = load("conversations").groupBy("conv_id").agg(F.concat(F.lit("# Log\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t"))), asc=False), lambda x: x["t"]), "")).alias("log"))
    return logs.select("conv_id", F.md5(documents.trim_turns("log")).alias("digest"))


@query("""
    SELECT item_id, 'All clear — board fully readable.' AS unread, '01 Situation: ' || array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n'),
           lambda p: trim(p) <> ''), lambda p: replace(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), chr(10), ' ')), ' / ') || ' | 02 Intent: hold' AS sections, '— Acknowledged. Out' AS ack FROM benchmark""")
def orders_parse(spark, load):
    md = F.concat(F.lit("lead\n## Situation\n\n"), F.col("text"), F.lit("\n\n## Intent\nhold\n— Acknowledged. Out\n"))
    parsed = orders.parse(load("benchmark").withColumn("md", md))
    one = F.array_join(F.transform("orders.sections", lambda s: F.concat(s["n"], F.lit(" "), s["title"], F.lit(": "), F.array_join(s["body"], " / "))), " | ")
    return parsed.select("item_id", "orders.unread", one.alias("sections"), "orders.ack")


@query("""
    WITH r AS (SELECT CASE WHEN doc_id % 6 IN (1, 5) THEN 'x' || doc_id ELSE 'b' || (doc_id // 2) END AS stem, doc_id % 6 = 3 AS digest, text FROM documents)
    SELECT coalesce(s.stem || '.digest.md', b.stem || '.md') AS name, coalesce(s.text, b.text) AS text, b.stem || '.md' AS book FROM r b LEFT JOIN r s ON s.stem = b.stem AND s.digest WHERE NOT b.digest""")
def prefer_digest(spark, load):
    name = F.expr("CASE WHEN doc_id % 6 IN (1, 5) THEN 'x' || doc_id || '.md' ELSE 'b' || (doc_id div 2) || if(doc_id % 6 = 3, '.digest.md', '.md') END")
    return documents.prefer_digest(load("documents").select(name.alias("name"), "text"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug FROM part")
def slugify(spark, load):
    return load("part").select("p_partkey", T.slugify("p_name").alias("slug"))


@query("""SELECT item_id, left(sha256('[{"content": "' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '", "role": "user"}]'), 16) AS hash FROM benchmark""")
def prompt_hash(spark, load):
    return load("benchmark").select("item_id", T.prompt_hash(T.messages("text")).alias("hash"))


@query("SELECT user_id, event_id AS turn, event_id = max(event_id) OVER (PARTITION BY user_id) AS current FROM events")
def turn_current_flag(spark, load):
    return campaign.with_current(load("events").select("user_id", F.col("event_id").alias("turn")), "user_id")


@query("SELECT CAST(user_id AS VARCHAR) AS slug, 'Campaign' AS name, round(1.5::DOUBLE + CAST(sum(round(CAST(value / 700 AS DECIMAL(28,8)), 6)) AS DOUBLE), 6) AS spend FROM events GROUP BY user_id")
def spend_total(spark, load):
    costs = load("events").select(F.col("user_id").cast("string").alias("slug"), (F.col("value") / 700).alias("cost_usd"))
    return campaign.add_spend(costs.select("slug").distinct().select("slug", F.lit("Campaign").alias("name"), F.lit(1.5).alias("spend")), costs).select("slug", "name", "spend")


@query("SELECT CAST(user_id AS VARCHAR) AS slug, max(event_id) AS turn FROM events GROUP BY user_id")
def current_turn(spark, load):
    return campaign.current_turn(load("events").select(F.col("user_id").cast("string").alias("slug"), F.col("event_id").alias("turn")))


@query("""
    WITH a AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS d FROM orders)
    SELECT o_orderkey, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN '1 day ago' WHEN d < 30 THEN d || ' days ago' ELSE (d // 30) || ' mo ago' END AS age FROM a""")
def age_bucket(spark, load):
    o = load("orders").withColumn("d", F.to_date("o_orderdate"))
    return _with(o, o.agg(F.max("d").alias("today"))).select("o_orderkey", V.age_bucket("d", F.col("today")).alias("age"))


@query("SELECT event_id, greatest(0.0::DOUBLE, 1.0::DOUBLE - (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0::DOUBLE / 30.0::DOUBLE) AS recency FROM events")
def recency_decay(spark, load):
    return _timed(load("events")).select("event_id", V.recency(V.age_days(F.col("now"), "ts")).alias("recency"))


@query("SELECT doc_id, CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END AS excerpt, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(strlen(text) // 4 AS BIGINT) AS tokens_by_bytes, left(replace(text, chr(10), ' '), 200) AS line FROM (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def excerpts(spark, load):
    return load("documents").select("doc_id", T.excerpt("text", 400).alias("excerpt"), T.token_estimate("text").alias("tokens"), T.token_estimate_bytes("text").alias("tokens_by_bytes"), T.one_line("text", 200).alias("line"))


@query(f"SELECT event_id, event_type <> 'error' AS valid, CASE WHEN event_type <> 'error' THEN {_K} END AS latency_ms, CASE WHEN event_type <> 'error' THEN CAST(printf('%.4f', value) AS DOUBLE) END AS cost_usd FROM events")
def header_extract(spark, load):
    e = load("events").withColumn("k", F.expr("get_json_object(props, '$.k')"))
    header = F.concat(F.lit("note\n[backend=x model=y template="), F.col("event_type"), F.lit(" corpus=3 latency_ms="), "k", F.lit(" cost_usd=$"), F.format_string("%.4f", "value"), F.lit("]\n"))
    checked = e.withColumn("c", T.validated(F.lit("body"), F.when(F.col("event_type") != "error", header).otherwise("[backend=x]")))
    return checked.select("event_id", "c.valid", F.col("c.latency_ms").cast("int").alias("latency_ms"), "c.cost_usd")


@query("""
    WITH s AS (SELECT doc_id, [CAST(doc_id % 4 AS INT), CAST(doc_id % 6 AS INT), CAST(doc_id % 9 AS INT)] AS ids FROM documents), n AS (SELECT doc_id, len(list_intersect(list_distinct(ids), [1, 2, 3])) AS shared FROM s)
    SELECT doc_id, CAST(shared AS INT) AS shared FROM n WHERE shared >= least(greatest((SELECT max(shared) FROM n), 1), 2)""")
def id_overlap(spark, load):
    ids = F.array(*(F.concat(F.lit("0"), (F.col("doc_id") % m).cast("string")) for m in (4, 6, 9)), F.lit("x"), F.lit(None).cast("string"))
    return relevance.id_overlap(load("documents").select("doc_id", ids.alias("retrieved_corpus_ids")), [1, 2, 3]).select("doc_id", "shared")


@query(f"SELECT role, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS skipped, 0.25::DOUBLE * count(*) FILTER (ok AND turn % 2 = 0) AS cost_usd FROM (SELECT role, turn, {_hits(MARKERS)} >= 2 AND length(text) >= 200 AS ok FROM conversations) GROUP BY role")
def generation_counts(spark, load):
    rows = load("conversations").withColumns({"keep": T.passes_quality("text", MARKERS), "cost_usd": F.when(F.col("turn") % 2 == 0, 0.25)})
    return distill.generation_report(rows, "role")


@query("""SELECT event_id, CASE WHEN value < 0.01 THEN printf('$%.4f', value) ELSE printf('$%.3f', value) END AS cost,
    CASE WHEN event_id < 1000 THEN event_id || 'ms' ELSE ((event_id + 50) // 100) // 10 || '.' || ((event_id + 50) // 100) % 10 || 's' END AS latency FROM events""")
def display_formats(spark, load):
    return load("events").select("event_id", T.format_cost("value").alias("cost"), T.format_latency("event_id").alias("latency"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, load):
    return readers.remaining(load("documents").select("doc_id"), load("labels"), "doc_id")


@query("SELECT c_custkey AS slug, c_name AS name FROM customer UNION ALL SELECT DISTINCT user_id, 'new' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def insert_absent(spark, load):
    old = load("customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"))
    return sinks.insert_absent(old, load("events").select(F.col("user_id").alias("slug")).distinct().withColumn("name", F.lit("new")))


@query(f"SELECT CASE WHEN doc_id % 5 = 0 THEN 'forgetting' ELSE 'strategic' END AS kind, condition, sum(least({_hits(MARKERS, 'response')} / 4.0::DOUBLE, 1.0::DOUBLE)) / count(*) AS mean_score, sum({_hits(MARKERS, 'response')}) / count(*) AS mean_hits, count(*) AS n FROM (SELECT doc_id, 'gold' AS condition, text AS response FROM documents UNION ALL SELECT doc_id, 'student', CASE WHEN lang = 'en' THEN text END FROM documents) WHERE response IS NOT NULL GROUP BY ALL")
def condition_long_form(spark, load):
    rows = load("documents").select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 5 == 0).alias("is_forgetting"), F.struct(F.col("text").alias("response")).alias("gold"), F.struct(F.when(F.col("lang") == "en", F.col("text")).alias("response")).alias("student"))
    long = evaluate.long_form(rows, ("gold", "student")).withColumn("kind", evaluate.kind(F.col("is_forgetting")))
    return evaluate.condition_means(long, ["kind", "condition"], "response", MARKERS)
