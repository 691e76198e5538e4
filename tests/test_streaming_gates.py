from __future__ import annotations

import random

import pytest

from calltide.operators import gates as batch
from calltide.streaming import gates
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")


def test_stream_and_batch_agree_after_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(("a", "a", "a", "b", None, f"p{rng.randrange(5)}")), rng.choice((True, False, None))) for i in range(400)]
    rng.shuffle(rows)  # rows of an earlier seq may come late
    schema = "seq long, project string, conclusion_changed boolean"
    source = str(tmp_path / "in")
    given = []
    for part in (rows[:150], rows[150:160], rows[160:]):  # three runs of the query, each from the checkpoint of the one before
        given += part
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
        told = gates.last_flags(stream, "project")
        run = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(300)
        assert run.exception() is None
        got = {r.project: (r.seen, r.last_rows, r.flagged, r.flag_status) for r in gates.present(spark, str(tmp_path / "out")).collect()}
        assert got.keys() == {p for _, p, _ in given}
        whole = spark.createDataFrame(given, schema)
        for project, (seen, last_rows, flagged, status) in got.items():
            own = whole.where(F.col("project").eqNullSafe(F.lit(project)))
            want = batch.last_flags(own).first()
            assert (seen, last_rows, flagged, status) == (own.count(), want.last_rows, want.flagged, want.flag_status), project
