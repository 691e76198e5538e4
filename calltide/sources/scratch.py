"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below spark.checkpoint.dir, deleted when the application ends. A local session without that setting gets a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(context.applicationId)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='calltide-')}"
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: what follows starts from there, also where an executor is lost."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders at ``path``, sorted; none where it is missing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether Spark's writer has finished the table at ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))
