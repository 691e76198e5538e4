"""Writers. Spark commits whole jobs, so an append or rewrite is seen entirely or not at all."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.text import block_quote
from calltide.functions.text import extension as extension_of
from calltide.sources.readers import IMAGE_MIME, IMAGE_MOST_BYTES, exists


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file through Hadoop, so that any store works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; nulls are written, text is not escaped."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def overwrite_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _swap(spark: SparkSession, beside: str, path: str) -> None:
    """Put the folder ``beside`` in the place of ``path``. Where a step fails, what was at ``path`` is there again, and OSError says so."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(conf)

    def moved(a: object, b: object) -> bool:
        try:
            return bool(fs.rename(a, b))
        except Py4JJavaError:  # some stores raise where others return false
            return False

    if not moved(target, old):
        fs.delete(made, True)
        raise OSError(f"{path} could not be moved; it is unchanged")
    if not moved(made, target):
        if not moved(old, target):
            raise OSError(f"{path} could not be replaced; its rows are in {old.toString()}")
        fs.delete(made, True)
        raise OSError(f"{path} could not be replaced; it is unchanged")
    fs.delete(old, True)


def with_flag(metrics: DataFrame, key: Column | str, value: bool | None, on: str = "timestamp", flag: str = "conclusion_changed") -> DataFrame:
    """Every row of the key with the flag set; null takes it back."""
    hit = F.col(on).eqNullSafe(F.lit(key) if isinstance(key, str) else key)
    return metrics.withColumn(flag, F.when(hit, F.lit(value).cast("boolean")).otherwise(F.col(flag)))


def update_flag(spark: SparkSession, path: str, key: str, value: bool | None, on: str = "timestamp", flag: str = "conclusion_changed") -> int:
    """Rewrite a folder of JSON lines with the flag set on every row of the key: written beside, then swapped.

    Only the field of that name at the top of a line changes; rows of other keys keep their line as it is, lines that are
    no JSON go. A key without rows raises KeyError and changes nothing.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line")).withColumn("v", F.try_parse_json("line")).where(F.col("v").isNotNull())
    hit = F.coalesce(F.try_variant_get("v", f"$.{on}", "string") == key, F.lit(False))
    hits = lines.where(hit).count()
    if not hits:
        raise KeyError(key)
    fields = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda name, _: name != flag)
    new = F.create_map(F.lit(flag), F.parse_json(F.lit("null" if value is None else str(value).lower())))
    beside = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    lines.select(F.when(hit, F.to_json(F.map_concat(fields, new), {"ignoreNullFields": "false"})).otherwise(F.col("line")).alias("value")).write.text(beside)
    _swap(spark, beside, path)
    return hits


def delete_source(spark: SparkSession, folder: str, kind: str, name: str) -> list[str]:
    """Delete a source of a campaign folder, and a rule book's PDF with it; the names of the files that went. Its digest stays.

    A kind other than rules and reference or an unsafe name raises ValueError, an absent file FileNotFoundError.
    """
    if kind not in ("rules", "reference") or "/" in name or ".." in name or not name.strip():
        raise ValueError(f"{kind}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{kind}/{n}")
    fs = at(name).getFileSystem(conf)
    if not fs.exists(at(name)) or fs.getFileStatus(at(name)).isDirectory():
        raise FileNotFoundError(f"{kind}/{name}")
    pdf = name.rsplit(".", 1)[0] + ".pdf"
    return [n for n in dict.fromkeys([name, pdf] if kind == "rules" else [name]) if fs.delete(at(n), False)]


def append_narrative(spark: SparkSession, path: str, section: str) -> None:
    """Add a section at the end of a campaign's turn log, one small file: written beside, then swapped; a missing log is begun."""
    old = spark.read.text(path, wholetext=True).first() if exists(spark, path) else None
    whole = (old.value if old else "# Turn log\n\n---\n") + section
    if old is None:
        write_text(spark, path, whole)
    else:
        beside = f"{path}-new-{uuid.uuid4().hex}"
        write_text(spark, beside, whole)
        _swap(spark, beside, path)


def quarantine(calls: DataFrame, checked: str = "checked") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) by a validated() column; invalid rows have ``text``, the error first."""
    ok = F.coalesce(F.col(f"{checked}.valid"), F.lit(False))
    text = F.concat(F.lit("# error: "), F.col(f"{checked}.error"), F.lit("\n\n## stdout\n\n"), F.coalesce("stdout", F.lit("")), F.lit("\n\n## stderr\n\n"), F.coalesce("stderr", F.lit("")), F.lit("\n"))
    return calls.where(ok), calls.where(~ok).withColumn("text", text)


def route_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (name, length) with ``route`` (rules, reference or error) and ``error``: PDF and text make rule books, images references."""
    ext = extension_of("name")
    large = ext.isin(*IMAGE_MIME) & (F.col("length") > IMAGE_MOST_BYTES)
    route = F.when(large, "error").when(ext.isin(".pdf", ".md", ".txt", ".markdown"), "rules").when(ext.isin(*IMAGE_MIME), "reference").otherwise("error")
    return uploads.withColumn("route", route).withColumn("error", F.when(large, "image too large").when(route == "error", F.concat(F.lit("unsupported type "), ext)))


def insert_absent(existing: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def replace_or_insert(existing: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new, allowMissingColumns=True)


def turn_narrative(turn: Column, time: Column, model: Column, status: Column, intent: Column, orders: Column) -> Column:
    """The Markdown section of one turn."""
    return F.concat(
        F.lit("\n## Turn "), turn.cast("string"), F.lit(" — "), time, F.lit(" (model: "), model, F.lit(")\n\n**Status:** "), status, F.lit("\n\n**Intent:** "), F.trim(F.coalesce(intent, F.lit(""))),
        F.lit("\n\n**Orders (verbatim):**\n\n"), block_quote(orders), F.lit("\n\n---\n"),
    )
