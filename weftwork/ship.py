"""Sends the package to the executors' Python workers, which need not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_weftwork_shipped", False):
        return
    package = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="weftwork-", suffix=".zip", delete=False) as file:
        with zipfile.ZipFile(file, "w") as archive:
            for path in sorted(package.rglob("*.py")):
                archive.write(path, path.relative_to(package.parent))
    context.addPyFile(file.name)
    context._weftwork_shipped = True
