"""Sessions: settings for large inputs, and the package on all executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and sizes shuffles; times are UTC; columnar exchange with Python.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: set[str] = set()


def session(name: str = "lodestone", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable by Python workers, once an application; Spark hands the file to executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    # the driver serves the file to executors until the application ends
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lodestone-package-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "lodestone_package.zip")
    Path(at).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)
