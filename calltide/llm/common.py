"""What the operators of this subpackage share: tables, materialisation in the shared folder, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.session import ship

#: Rows and bytes of an Arrow batch that goes to a Python worker; one row larger than that is a batch of its own.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 4 << 20
#: Default words of a shingle and least Jaccard similarity of near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
_OWN_DIRS: dict[str, str] = {}
#: Tables of this Python worker that last from task to task, and the keys of those that its present task has asked for.
_HELD: dict[str, Any] = {}
_USED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH, size: int = BYTES_PER_BATCH) -> None:
    """Lower the session's rows and bytes per Arrow batch, so that a batch of whole texts stays small, and see that workers can import us.

    Plans read these settings when they run, so they stay lowered for the session; they are never raised.
    """
    ship(spark)
    for key, default, most in (("maxRecordsPerBatch", 10_000, rows), ("maxBytesPerBatch", 64 << 20, size)):
        found = re.match("-?[0-9]+", str(spark.conf.get(f"spark.sql.execution.arrow.{key}", str(default))))
        now = int(found[0]) if found else default
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def held(key: str, make: Callable[[], Any]) -> Any:
    """A table that this Python worker keeps from task to task, until a ``lean`` task ends that did not ask for it."""
    _USED.add(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return memory that was freed to the system: a worker outlives its tasks and counts to its executor while others run."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc has it
        trim(0)


def _begin_task() -> None:
    _USED.clear()


def _end_task() -> None:
    for key in _HELD.keys() - _USED:
        del _HELD[key]
    give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow at the end of whose tasks the worker keeps neither freed memory nor ``held`` tables of other operators."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin_task()
        yield from run(batches)
        _end_task()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN_DIRS.get(context.applicationId) or f"file://{tempfile.mkdtemp(prefix='calltide-')}"
        _OWN_DIRS[context.applicationId] = found
    return found.rstrip("/")


def materialize(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    Shuffle files of what is written by now are needed no more; the driver's collection lets Spark delete them.
    The files go when the application ends; ``drop_table`` removes them earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/calltide-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._calltide_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing will read it any more."""
    path = getattr(df, "_calltide_path", None)
    if path:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def partitions(rows: int, rows_each: int, least: int = 1, most: int = 20_000) -> int:
    """How many partitions for so many rows."""
    return max(least, min(most, -(-rows // rows_each)))
