"""Extension: call logs as a file stream. New files of JSON lines are read once, late rows up to a watermark count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calltide.functions.text import strip
from calltide.functions.values import exact_average, parse_timestamp
from calltide.sources.readers import field, number_field


def stream_metrics(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(ts, timestamp, mode, cost_usd, conclusion_changed, maintenance_hours) of well-formed lines as they arrive."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
    rows = lines.select(F.try_parse_json(strip("value")).alias("v")).where(F.col("v").isNotNull())
    fields = rows.select(field("timestamp", "string"), field("mode", "string"), number_field("cost_usd"), field("conclusion_changed", "boolean"), number_field("maintenance_hours"))
    return fields.withColumn("ts", parse_timestamp("timestamp")).where(F.col("ts").isNotNull())


def rolling_cost(metrics: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls and average cost by event-time window; state of windows older than the watermark is dropped."""
    windows = metrics.withWatermark("ts", late).groupBy(F.window("ts", window, slide))
    return windows.agg(F.count(F.lit(1)).alias("calls"), exact_average("cost_usd").alias("avg_cost")).select("window.start", "window.end", "calls", "avg_cost")


def write_once(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, exactly once per input file, and stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
