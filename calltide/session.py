"""Session set-up that every entry point shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def build(app: str = "calltide", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is there."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: once per application, and only where PYTHONPATH doesn't do it already."""
    context = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.applicationId in _SHIPPED or str(ROOT.parent) in on_path:
        return
    archive = Path(tempfile.mkdtemp(prefix="calltide-ship-")) / "calltide.zip"  # served to the executors by the driver
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
