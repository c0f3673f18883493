"""Spark sessions for the command line, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = os.path.join(tempfile.mkdtemp(prefix="passagemill-code-"), "passagemill.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(PACKAGE.rglob("*.py")):
                z.write(source, source.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped[app] = archive
    return spark


def local_session(cores: str = "*", app: str = "passagemill", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the submitter's settings apply instead."""
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cores}]")
    n = os.cpu_count() if cores == "*" else int(cores)
    defaults = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
