"""Making the package importable where Python workers run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their Python path has it (once an application)."""
    root = os.path.dirname(_HERE)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _DONE or any(os.path.realpath(p) == os.path.realpath(root) for p in paths if p):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="warraq-ship-"), "warraq.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(_HERE):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    spark.sparkContext.addPyFile(archive)
    _DONE.add(app)


def shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
