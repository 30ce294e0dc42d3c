"""Working tables in the folder that driver and executors share.

They are Parquet under ``spark.checkpoint.dir`` (one fresh sub-folder a call), so a lost
executor costs a re-read.  Only where that setting is unset (unit tests in local mode) a
folder of our own is made.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship

_OWN: dict[str, str] = {}
#: Folders made inside each open ``working_tables``, innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="warraq-")
    return _OWN[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path; what is going to run there finds the package on the workers."""
    ship(spark)
    path = f"{shared_dir(spark)}/warraq/{name}-{uuid.uuid4().hex[:12]}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextlib.contextmanager
def working_tables(spark: SparkSession):
    """Working tables that operators make inside are deleted at the end, when their results have been written."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop_stage(spark, path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over as many tasks as the session's shuffles have: rows of a small file are else one task's, however much work each is."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts lineage, gives exact sizes."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
