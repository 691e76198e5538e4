"""The registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.llm import ann, decontaminate, hard_negatives, jaccard_join, language, licenses, line_dedup, ogg_media, packing, periodic_runs, pii, quality, url_filters
from calltide.llm.common import crc_mod, table

TOKENIZER = "word_bpe_49k.json"


#: The constant part of op1's dated list: (target, verdict, listed at, in seconds since 1970). The other part, which grows
#: with the table, has an entry for the host or the first part of the path of every fifth page.
LIST_ENTRIES = [
    ("example.net", "block", 1704844800), ("example.net", "remove", 1711929600), ("example.net", "block", 1719792000),
    ("tionsh.example.net", "allow", 1706745600), ("tionsh.example.net", "block", 1715000000), ("tionsh.example.net", "allow", 1725000000),
    ("example.org/de", "block", 1709251200), ("example.org/de/2", "allow", 1712000000), ("example.org", "allow", 1704067200),
    ("blog.tionble.example.com", "block", 1707000000), ("blog.tionble.example.com/en", "allow", 1707000000), ("m.tiontion.example.com", "block", 1720000000),
    ("m.tiontion.example.com", "allow", 1720000000), ("ththhe.example.com", "block", 1700000000), ("com", "allow", 1700000000), ("com/es", "block", 1716000000),
]
#: `pages` has no fetch time: one within 2024 follows from page_id.
FETCHED_AT = "1704067200 + page_id * 9973 % 31536000"
OWN_LISTED_AT = "1704067200 + page_id * 7919 % 31536000"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED_AT).alias("fetched_at"))
    entries = spark.sql(f"SELECT target, verdict, CAST(listed_at AS BIGINT) AS listed_at FROM VALUES {', '.join(map(str, LIST_ENTRIES))} AS e(target, verdict, listed_at)")
    own = pages.select("page_id", url_filters.host_of(F.col("url")).alias("host"), url_filters.path_of(F.col("url")).alias("path")).where("page_id % 5 = 1 AND host IS NOT NULL")
    target = F.concat("host", F.when(F.col("page_id") % 2 == 1, F.regexp_extract("path", "^(/[^/]*)", 1)).otherwise(""))
    entries = entries.unionByName(own.select(target.alias("target"), F.element_at(F.array(*map(F.lit, url_filters.VERDICTS)), (F.col("page_id") % 3 + 1).cast("int")).alias("verdict"), F.expr(OWN_LISTED_AT).alias("listed_at")))
    return url_filters.evaluate(pages, entries).select("page_id", "url", "host", "fetched_at", "verdict", "target", "listed_at", "keep")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(crc_mod("doc_id", 4) != 2))
    out = language.predict(docs.withColumn("held_out", crc_mod("doc_id", 4) == 2), model, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


#: `documents` has no paths: a source is a tree of directories of 50 files, the first of which is its LICENSE.
PATH = "concat('repo/', coalesce(source, 'none'), '/p', doc_id div 500, '/m', (doc_id div 50) % 10, '/', if(doc_id % 50 = 0, 'LICENSE', concat('f', doc_id, '.txt')))"


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", F.expr(PATH)), templates=licenses.all_templates())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1))
    out = quality.score(docs.withColumn("held_out", crc_mod("doc_id", 3) == 1), model, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.judged_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform(F.sort_array("removed"), lambda i: i.cast("string")), ",").alias("removed"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


def op11_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.plant(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_ogg_media": op11_ogg_media,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": f"""
        WITH p AS (SELECT page_id, url, CAST({FETCHED_AT} AS BIGINT) AS fetched_at, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host,
                     regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
        feed(target, verdict, listed_at) AS (VALUES {", ".join(map(str, LIST_ENTRIES))}),
        entries AS (SELECT target, verdict, listed_at FROM feed UNION ALL
                    SELECT host || CASE WHEN page_id % 2 = 1 THEN regexp_extract(CASE path WHEN '' THEN '/' ELSE path END, '^(/[^/]*)', 1) ELSE '' END,
                           CASE page_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'remove' END, {OWN_LISTED_AT} FROM p WHERE page_id % 5 = 1 AND host <> ''),
        one AS (SELECT regexp_extract(target, '^([^/]*)', 1) AS domain, regexp_extract(target, '^[^/]*(/.*)$', 1) AS path, listed_at,
                       arg_min(verdict, CASE verdict WHEN 'block' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS verdict FROM entries GROUP BY ALL),
        valid AS (SELECT *, lead(listed_at) OVER (PARTITION BY domain, path ORDER BY listed_at) AS valid_to FROM one),
        hit AS (SELECT p.page_id, v.verdict, v.domain || v.path AS target, v.listed_at,
                       row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(v.domain, '.')) DESC, len(v.path) DESC) AS k
                FROM p JOIN valid v ON (p.host = v.domain OR ends_with(p.host, '.' || v.domain)) AND starts_with(CASE p.path WHEN '' THEN '/' ELSE p.path END, v.path)
                  AND p.fetched_at >= v.listed_at AND (v.valid_to IS NULL OR p.fetched_at < v.valid_to) WHERE v.verdict <> 'remove')
        SELECT p.page_id, url, host, fetched_at, verdict, target, CAST(listed_at AS BIGINT) AS listed_at, coalesce(verdict <> 'block', TRUE) AS keep
        FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND k = 1
    """,
    "op8_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
                     FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT doc_id, least(doc_id, coalesce(least.b, doc_id)) AS class_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
        FROM d LEFT JOIN least ON least.a = doc_id LEFT JOIN degree ON degree.a = doc_id
    """,
    "op9_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS body FROM split WHERE ls IS NOT NULL),
        words AS (SELECT doc_id, line, regexp_extract_all(lower(body), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM lines),
        shingles AS (SELECT DISTINCT doc_id, line, array_to_string(ws[i:i + 4], ' ') AS s
                     FROM (SELECT doc_id, line, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
        sizes AS (SELECT doc_id, line, count(*) AS n FROM shingles GROUP BY doc_id, line),
        common AS (SELECT x.doc_id, x.line, y.doc_id AS d, y.line AS l, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s
                   WHERE (y.doc_id, y.line) < (x.doc_id, x.line) GROUP BY ALL),
        removed AS (SELECT DISTINCT common.doc_id, common.line FROM common
                    JOIN sizes a ON a.doc_id = common.doc_id AND a.line = common.line JOIN sizes b ON b.doc_id = d AND b.line = l
                    WHERE 100 * c >= 80 * (a.n + b.n - c)),
        listed AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS list FROM removed GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(list, '') AS removed
        FROM split LEFT JOIN listed USING (doc_id)
    """,
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
        bw AS (SELECT item, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g
                FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bw)),
        lens AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
               FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens)),
        hits AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
                   FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
}
