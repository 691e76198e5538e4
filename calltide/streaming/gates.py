"""The flag gate on a stream: the last flags of each project are kept as state, so that no batch reads the log again.

State is one small row per project: its last N flags by seq and how many rows it has seen. It lives in the state store beside
the checkpoint; a query that is stopped and started again goes on from there. State of projects that have been silent for
``ttl`` goes. Python state needs the RocksDB store and the protobuf package.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from calltide.operators.gates import Limits, flag_status
from calltide.session import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastFlags(StatefulProcessor):
    """(key, seen, last_seq, last_rows, flagged) of each key that a batch brings rows of; the last ``n`` are those of largest seq."""

    def __init__(self, n: int, ttl_ms: int | None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "seen long, seqs array<long>, flags array<boolean>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, last = 0, []
        if self.kept.exists():
            seen, seqs, flags = self.kept.get()
            last = list(zip(seqs, flags, strict=True))
        for part in rows:
            seen += len(part)
            new = part.nlargest(self.n, "seq")  # more than n rows of one batch never matter
            last = sorted([*last, *((int(s), bool(f)) for s, f in zip(new["seq"], new["flag"], strict=True))])[-self.n :]
        self.kept.update((seen, [s for s, _ in last], [f for _, f in last]))
        yield pd.DataFrame({"project": [key[0]], "seen": [seen], "last_seq": [last[-1][0]], "last_rows": [len(last)], "flagged": [sum(f for _, f in last)]})

    def close(self) -> None:
        pass


def last_flags(metrics: DataFrame, project: str, limits: Limits = Limits(), flag: str = "conclusion_changed", seq: str = "seq", ttl_days: float | None = None) -> DataFrame:
    """A stream of (project, seen, last_seq, last_rows, flagged, flag_status): each project's gate after each batch with rows of it.

    The row of largest ``seen`` is a project's present state. A null project is one of its own; a null flag counts as false;
    rows may come in any order, since the last ones are those of largest seq; rows without seq are left out.
    """
    spark = metrics.sparkSession
    ship(spark)
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)
    rows = metrics.select(F.col(project).cast("string").alias("project"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(flag), F.lit(False)).alias("flag")).where("seq IS NOT NULL")
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)
    held = rows.groupBy("project").transformWithStateInPandas(LastFlags(limits.last_n, ttl), "project string, seen long, last_seq long, last_rows int, flagged int", "append", "None" if ttl is None else "ProcessingTime")
    return held.withColumn("flag_status", flag_status(limits))


def present(spark: SparkSession, path: str) -> DataFrame:
    """The present state of every project, from what the stream has written at ``path``."""
    rows = spark.read.parquet(path)
    return rows.groupBy("project").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "project")), "seen").alias("r")).select("project", "r.*")
