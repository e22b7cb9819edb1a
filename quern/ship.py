"""The package's code for Python workers: executors need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    name = f"{tempfile.mkdtemp(prefix='quern-code-')}/quern.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent).as_posix())
    sc.addPyFile(name)
