"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def bounded_batches(spark: SparkSession, limit: str = "8m") -> None:
    """Arrow batches of at most about `limit`, unless the session says otherwise: 10,000 rows of long texts are too much to hold in a task."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, limit)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker serves many tasks, and must not hold what an earlier one needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: What a Python worker holds from task to task, by name: each is a table that an operator fills and may find empty.
HELD: dict[str, dict] = {}


def let_go(keep: str | None) -> None:
    """Drops what other operators have left in this worker, as workers outlive stages."""
    for name, table in HELD.items():
        if name != keep:
            table.clear()


def frugal(run, keep: str | None = None):
    """A function for mapInArrow that drops what other operators hold but `keep`, and gives memory back at the end of its task."""

    @wraps(run)
    def wrapped(batches):
        let_go(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def frugal_group(run):
    """The same for a function of applyInArrow, which counts its arguments: after each group."""

    def after(*args):
        let_go(None)
        try:
            return run(*args)
        finally:
            give_back()

    if run.__code__.co_argcount == 3:
        return lambda key, left, right: after(key, left, right)
    return lambda key, table: after(key, table)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session that has no other machine (local[n])
    gets a temporary one; on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexiflow-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The tables made inside each open scratch(), innermost last.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Deletes the tables that stored() has made inside, but those it was told to keep, once what came from them has been stored."""
    _SCOPES.append([])
    try:
        yield
    finally:
        forget(*_SCOPES.pop())


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiflow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing will read again, as all that came from them has been stored."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def made_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that tasks write themselves."""
    folder = f"{shared_dir(spark)}/lexiflow-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    return str(files.makeQualified(path).toString()).replace("file:/", "file:///", 1) if folder.startswith("file:") else folder


#: Rows of ids and a number or two that may be broadcast: a few megabytes.
BROADCAST_ROWS = 200_000
RUN = 4096


def running_totals(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, base): the sum of n over all rows before, in the order of the keys, of which the first is a partition's number. Sums are made
    in two levels, over runs of RUN partitions and within them, so that a task orders at most so many partitions' rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = df.select(*keys, n).withColumn("run", F.floor(F.col(keys[0]) / RUN))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.sum(n).alias("total")).select("run", F.coalesce(F.sum("total").over(upto(Window.orderBy("run"))), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum(n).over(upto(Window.partitionBy("run").orderBy(*keys))), F.lit(0))
    return rows.withColumn("inner", inner).join(runs, "run").select(*keys, (F.col("before") + F.col("inner")).alias("base"))


def light(df: DataFrame, name: str) -> DataFrame:
    """A narrow table (ids and numbers), stored: a join sends it to all tasks while it has at most BROADCAST_ROWS rows, and else moves both sides."""
    from pyspark.sql import functions as F

    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def with_base(df: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """df with the base of its keys."""
    return df.join(light(bases, "bases"), keys)


def text_megabytes(df: DataFrame, column: str) -> float:
    """Total UTF-8 megabytes of a text column, over all rows."""
    from pyspark.sql import functions as F

    return (df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0) / 1e6


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A column as one array."""
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def chunks_by_bytes(batches, text: str, limit: int = 4 << 20):
    """Splits record batches into slices of about `limit` bytes of text, at least one row each, so that memory is bounded."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        at, total = 0, np.cumsum(sizes, dtype=np.int64)
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
