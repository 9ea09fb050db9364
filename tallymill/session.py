"""Session settings the jobs are written for."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Days are UTC days. Very wide projections otherwise end in one generated method that the JVM only
# interprets: 8000 bytes is the largest method HotSpot compiles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application, so that Python stages can import it there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="package-")
        archive = shutil.make_archive(f"{folder}/{home.name}", "zip", home.parent, home.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark
