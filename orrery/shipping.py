"""Sending this package to the executors, which need it to run its Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once for each Spark application."""
    if spark.sparkContext.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="package")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
    _sent.add(spark.sparkContext.applicationId)
