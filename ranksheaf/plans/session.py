"""Makes the package importable where Python runs on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, unless PYTHONPATH brings it there."""
    context = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _shipped or str(PACKAGE.parent) in known:
        return
    top = tempfile.mkdtemp(prefix="spark-")
    context.addPyFile(shutil.make_archive(f"{top}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))
    _shipped.add(context.applicationId)
