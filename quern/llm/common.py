"""Helpers that the corpus operators share: shared work folders, skew-proof lookups, bounded lists."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch (but for a longer text, which is one).
BATCH_BYTES, _BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of one key that go together in a lookup, and keys that may be dealt apart.
ROWS_A_TASK, HOT_KEYS = 500, 1_000


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and every executor see.

    It is the one the cluster names in spark.checkpoint.dir.  Where that is unset, a local master gets the
    machine's own temporary folder (all tasks run there) and any other master the warehouse's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"file://{tempfile.gettempdir()}/quern-shared"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quern-shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"


_own = threading.local()


def made() -> set[str]:
    """Tables that this thread has written and not yet dropped."""
    return set(_own.__dict__.get("paths", ()))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage, and the table's path."""
    path = new_path(df.sparkSession, name)
    _own.__dict__.setdefault("paths", set()).add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        _own.__dict__.get("paths", set()).discard(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after whose end the worker gives freed memory back: workers wait for other tasks and keep what they hold.

    Batches of the session, of which worker and executor hold several, are bounded by BATCH_BYTES unless it sets its own bound.
    """
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)

    def and_then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return and_then_trim


def salted_lookup(rows: DataFrame, unique: DataFrame, key: str, spread: Column, count: str) -> DataFrame:
    """Left join of ``rows`` with ``unique``, which has one row for each value of ``key`` and, in ``count``, the rows that have it; ``count`` isn't kept.

    Rows of a frequent key are dealt over several tasks by ``spread``, which must differ between them, and the key's row of
    ``unique`` is copied for each: one copy for ROWS_A_TASK rows, so that copies are few beside the rows.  Only the HOT_KEYS
    most frequent keys are told apart, in a table of that size, which is broadcast: any other key has less than one in
    HOT_KEYS of all rows.  Rows without a key, which find nothing, are dealt likewise.
    """
    hot = unique.filter(F.col(key).isNotNull() & (F.col(count) > ROWS_A_TASK)).orderBy(F.desc(count)).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(key, F.ceil(F.col(count) / ROWS_A_TASK).cast("int").alias("__salts")))
    salts = F.when(F.col(key).isNull(), F.lit(HOT_KEYS)).otherwise(F.coalesce("__salts", F.lit(1)))
    left = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")
    right = unique.drop(count).join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [key, "__salt"], "left").drop("__salt")
