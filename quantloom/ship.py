"""Makes this package importable on the executors.

Python functions that run in Spark tasks are pickled by reference, so every
executor has to be able to import the package. A cluster may have it installed;
where it has not, the driver adds a zip of the sources to the session once.
"""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_done: set[str] = set()


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quantloom-"), "quantloom_src.zip")
    Path(path).write_bytes(_zip())
    spark.sparkContext.addPyFile(path)
    _done.add(app)


def shipped(plan: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(plan)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return plan(spark, sf_dir)

    return run
