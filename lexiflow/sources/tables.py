"""Tables that an operator computes once and reads many times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []
_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session that has no other machine (local[n]) gets a temporary folder; on a cluster that
    is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexiflow-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch():
    """Deletes the tables made inside once what was computed from them has been written or collected. Without a scope tables stay until the
    program ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        gone = set(_SCOPES.pop())
        for spark, path in [m for m in _MADE if m[1] in gone]:
            _delete(spark, path)
            _MADE.remove((spark, path))


@atexit.register
def _leave_nothing() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: S110  the session may have been stopped, and its folder with it
            pass


def once(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table, read back: its plan is a scan whose size is known. What is one already stays as it is."""
    if getattr(df, "stored_at", None):
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexiflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _MADE.append((spark, path))
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out
