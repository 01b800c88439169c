"""Giving the package to the Python workers of a cluster."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once for each application, so that functions which run there
    find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="bindery-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, Path(package.name) / path.relative_to(package))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)  # executors fetch it as long as the application runs
    _shipped.add(sc.applicationId)
