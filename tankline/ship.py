"""Sends the package to the executors, whose Python workers may not find it otherwise."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Add the package's code to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tankline_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-code-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._tankline_shipped = True
