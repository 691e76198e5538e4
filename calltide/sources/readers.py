"""Readers of call logs, campaign folders and document files. Order within a file is an explicit ``seq``."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.functions.text import col, corpus_ids, extension, stem, strip

IMAGE_MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}
IMAGE_MOST_BYTES = 20 * 1024 * 1024
LARGE_BYTES = 2 * 1024 * 1024


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line): seq rises with the line's place within its file; a missing path has no lines."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, seq long, line string")
    # a task reads a stretch of a file in order, and its rows are numbered in that order; file and stretch come first
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return rows.select("file", (F.col("block") * 4_294_967_296 + F.col("n").bitwiseAND((1 << 33) - 1) % 4_294_967_296).alias("seq"), "line")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, v VARIANT) of the lines that are JSON; blank and malformed ones are left out, a missing path has none."""
    rows = jsonl_lines(spark, path).withColumn("v", F.try_parse_json(strip("line")))
    return rows.where(F.col("v").isNotNull()).drop("line")


def field(name: str, kind: str, v: Column | str = "v") -> Column:
    """A field of a VARIANT row, null where it is missing or doesn't convert; a boolean must be one in the JSON."""
    value = F.try_variant_get(col(v), f"$.{name}", kind)
    if kind == "boolean":
        value = F.when(F.schema_of_variant(F.try_variant_get(col(v), f"$.{name}", "variant")) == "BOOLEAN", value)
    return value.alias(name)


def number_field(name: str, v: Column | str = "v") -> Column:
    """A field that is a JSON number (or boolean, as 0 and 1); digits in a string are no number."""
    held = F.try_variant_get(col(v), f"$.{name}", "variant")
    kind = F.schema_of_variant(held)
    as_bool = F.try_variant_get(col(v), f"$.{name}", "boolean").cast("double")
    return F.when(kind == "BOOLEAN", as_bool).when(kind.isin("STRING", "VOID") | kind.startswith("OBJECT") | kind.startswith("ARRAY"), None).otherwise(F.try_variant_get(col(v), f"$.{name}", "double")).alias(name)


CALL_FIELDS = {
    "timestamp": "string", "mode": "string", "query": "string", "template": "string", "model": "string", "response": "string", "state_dir": "string",
    "preamble_tokens": "bigint", "preamble_text_tokens": "bigint", "injected_prior_count": "bigint", "latency_ms": "bigint", "wrapper_elapsed_ms": "bigint",
    "new_query_corpus_ids": "array<int>", "matched_prior_corpus_ids": "array<int>", "retrieved_corpus_ids": "array<string>", "images": "array<string>", "xlsx": "array<string>",
}
METRIC_FIELDS = {
    "timestamp": "string", "mode": "string", "preamble_tokens": "bigint", "match_count": "bigint", "image_count": "bigint", "xlsx_count": "bigint", "latency_ms": "bigint", "wrapper_elapsed_ms": "bigint",
    "exit_code": "int", "conclusion_changed": "boolean",
}


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Audit and vision rows of a call log under one schema, with cost_usd, usage_cost, usage_total_cost, ``nulls`` and seq.

    ``nulls`` lists the text fields that the line has as null, which a missing field is not.
    """
    usage = lambda name: F.try_variant_get("v", f"$.usage.{name}", "double").alias(f"usage_{name}")
    is_null = lambda n: F.coalesce(F.is_variant_null(F.try_variant_get("v", f"$.{n}", "variant")), F.lit(False))
    nulls = F.filter(F.array(*(F.when(is_null(n), n) for n in ("model", "template", "query", "response"))), lambda n: n.isNotNull()).alias("nulls")
    return read_jsonl(spark, path).select("seq", *(field(n, k) for n, k in CALL_FIELDS.items()), number_field("cost_usd"), usage("cost"), usage("total_cost"), nulls)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of both writers under one schema; conclusion_changed is true only for JSON true."""
    return read_jsonl(spark, path).select("seq", *(field(n, k) for n, k in METRIC_FIELDS.items()), number_field("cost_usd"), number_field("maintenance_hours"))


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = False) -> DataFrame:
    """JSON lines of a known schema; a malformed line fails the read. Blank lines are skipped."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_json_document(spark: SparkSession, path: str, default: object) -> object:
    """One small JSON file as a Python value; ``default`` where it is missing or malformed."""
    try:
        text = spark.read.text(path, wholetext=True).first()
        return json.loads(text.value) if text else default
    except (AnalysisException, ValueError):
        return default


def documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, name, text) of whole text files, to be ordered by name."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, ext, length, modified, content) of files; content is read only where it is used."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), extension("path").alias("ext"), "length", F.col("modificationTime").alias("modified"), "content")


def campaigns(found: DataFrame, example: str | None = None) -> DataFrame:
    """(slug, dir, is_example) of the folders that hold a MISSION.md, from a table of file paths; the example first, the rest by name."""
    held = found.where(F.col("name") == "MISSION.md").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct()
    slug = F.element_at(F.split("dir", "/"), -1)
    return held.select(slug.alias("slug"), "dir", F.coalesce(slug == F.lit(example), F.lit(False)).alias("is_example")).orderBy(F.desc("is_example"), "slug", "dir")


def resolve_state_dir(spark: SparkSession, explicit: str | None, project: str | None, root: str, cwd_name: str) -> str | None:
    """An explicit folder if it exists (and then no other), else the project's, else the one named like the work folder."""
    if explicit:
        return explicit if exists(spark, explicit) else None
    at = f"{root}/{project or cwd_name}"
    return at if exists(spark, at) else None


def images(found: DataFrame, most_bytes: int = IMAGE_MOST_BYTES) -> DataFrame:
    """(path, url, error): data URLs of image files; other extensions and larger files have an error."""
    mime = F.element_at(F.create_map(*(F.lit(x) for pair in IMAGE_MIME.items() for x in pair)), F.col("ext"))
    error = F.when(mime.isNull(), "unsupported image type").when(F.col("length") > most_bytes, "image too large")
    url = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", ""))
    return found.select("path", F.when(error.isNull(), url).alias("url"), error.alias("error"))


def with_size_flag(found: DataFrame, most_bytes: int = LARGE_BYTES) -> DataFrame:
    """Files with ``large``: those that are better not read whole into a prompt."""
    return found.withColumn("large", F.col("length") > most_bytes)


def file_totals(found: DataFrame) -> DataFrame:
    """One row: files, bytes, kb (rounded for each file) and tokens_est of (length) rows; zeros of none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg(F.count(F.lit(1)).alias("files"), total("length").alias("bytes"), total(F.floor(F.col("length") / 1024 + 0.5)).alias("kb"), total(F.floor(F.col("length") / 4)).alias("tokens_est"))


def source_list(rules: DataFrame, references: DataFrame) -> DataFrame:
    """Rule books (.md, not digests) and then reference images, one schema: kind, name, size, tokens, origin, digest.

    ``source`` says whether a book's PDF lies beside it.
    """
    ends = lambda e: F.col("name").endswith(e)
    digest = rules.where(ends(".digest.md")).select(F.regexp_replace(stem("name"), r"\.digest$", "").alias("book"), F.col("length").alias("digest_size_bytes"))
    pdf = rules.where(ends(".pdf")).select(stem("name").alias("book"), F.lit(True).alias("pdf")).distinct()
    books = rules.where(ends(".md") & ~ends(".digest.md")).withColumn("book", stem("name")).join(digest, "book", "left").join(pdf, "book", "left")
    first = books.select(
        F.lit("rules").alias("kind"), "name", F.col("length").alias("size_bytes"), F.floor(F.col("length") / 4).alias("tokens_est"),
        F.when(F.col("pdf"), "converted from pdf").otherwise("uploaded markdown").alias("source"), F.col("digest_size_bytes").isNotNull().alias("has_digest"),
        "digest_size_bytes", F.floor(F.col("digest_size_bytes") / 4).alias("digest_tokens_est"),
    )
    second = references.where(F.col("ext").isin(*IMAGE_MIME)).select(F.lit("reference").alias("kind"), "name", F.col("length").alias("size_bytes"), F.lit(None).cast("long").alias("tokens_est"), F.lit(False).alias("has_digest"))
    return first.unionByName(second, allowMissingColumns=True).orderBy(F.desc("kind"), "name")


def sheet_markdown(cells: DataFrame) -> DataFrame:
    """(workbook, markdown) of (workbook, sheet_no, sheet, row_no, cells array<string>), one row per sheet row.

    The row of least number heads a sheet's table; other rows are cut or filled to its width, null cells are empty. A
    sheet without rows stands with row_no null.
    """
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    fitted = lambda row, width: F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.coalesce(F.get(row, k), F.lit("")))
    held = F.array_sort(F.collect_list(F.when(F.col("row_no").isNotNull(), F.struct("row_no", "cells"))))
    sheets = cells.groupBy("workbook", "sheet_no", "sheet").agg(held.alias("rows")).withColumn("width", F.size(F.get("rows", F.lit(0))["cells"]))
    lines_ = F.transform("rows", lambda r: F.when(F.col("width") > 0, line(fitted(r["cells"], F.col("width")))).otherwise("|  |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.greatest("width", F.lit(0))), "|"), F.lit("|"))
    table = F.when(F.size("rows") == 0, "_(empty)_").otherwise(F.concat_ws("\n", F.get(lines_, F.lit(0)), rule, F.slice(lines_, F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))))
    section = F.concat(F.lit("\n#### sheet: "), "sheet", F.lit("\n\n"), table)
    joined = F.array_sort(F.collect_list(F.struct("sheet_no", section.alias("section"))))
    return sheets.groupBy("workbook").agg(F.concat_ws("\n", F.concat(F.lit("### "), "workbook"), F.transform(joined, lambda x: x["section"])).alias("markdown"))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a workbook as ``sheet_markdown`` takes them; needs the optional package openpyxl and a local file, as attachments are."""
    try:
        from openpyxl import load_workbook
    except ImportError as error:
        raise RuntimeError("reading .xlsx needs openpyxl") from error
    name, rows = path.rsplit("/", 1)[-1], []
    for number, sheet in enumerate(load_workbook(path, data_only=True).worksheets):
        held = [[None if c is None else str(c) for c in row] for row in sheet.iter_rows(values_only=True)]
        rows += [(name, number, sheet.title, k, cells) for k, cells in enumerate(held)] or [(name, number, sheet.title, None, None)]
    return spark.createDataFrame(rows, "workbook string, sheet_no int, sheet string, row_no int, cells array<string>")


def scan_corpus_ids(rows: DataFrame, text: str, show_prompt: Callable[[str], dict]) -> DataFrame:
    """``rows`` with ``ids`` of the corpus entries that a command would put into its prompt, and ``error``.

    ``show_prompt`` runs the command on a text and returns {"output": …, "code": …}; another code than 0 is an error.
    """
    called = call_model(rows, text, show_prompt, "output string, code int")
    failed = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("code", F.lit(0)) != 0, F.concat(F.lit("exit code "), F.col("code").cast("string")))
    return called.withColumn("error", failed).withColumn("ids", F.when(F.col("error").isNull(), corpus_ids(F.coalesce("output", F.lit(""))))).drop("output", "code")


def call_model(rows: DataFrame, text: str, fn: Callable[[str], dict], schema: str) -> DataFrame:
    """``rows`` with the fields of fn(text), called once a row in batches; an exception becomes ``error``.

    The place where calls of models and command-line tools plug in. ``schema`` lists the fields fn may return.
    """
    wanted = [f.name for f in T.StructType.fromDDL(schema)]
    out = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(schema).fields, T.StructField("error", T.StringType())])

    def one(value: object) -> dict:
        try:
            return fn(value)
        except Exception as e:  # a failed call is a row with an error
            return {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(v) for v in pdf[text]]
            yield pdf.assign(**{n: [g.get(n) for g in got] for n in [*wanted, "error"]})

    return rows.mapInPandas(run, out)


def remaining(todo: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """The rows whose key has no finished row yet."""
    return todo.join(done.select(key), key, "left_anti")
