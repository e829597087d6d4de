"""What the operators share: the cluster's shared folder, cut lineages, importable workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship

#: Bytes of rows that a Python worker is sent at once, so that many long texts in a row don't fill it.
BATCH_BYTES = 8 << 20


def release() -> None:
    """Give the memory that a worker no longer uses back to the system, at the end of a task: idle workers stay beside the next stage's JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def prepare(spark: SparkSession) -> None:
    """Send the workers this package and bound their batches; the session keeps that setting."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in spark.checkpoint.dir; a temporary one only where the session names none and runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixframe-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget its lineage. A lost executor loses nothing of it; Spark removes it when it is no longer referred to."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as a Parquet table in the shared folder, and what removes it.

    For loops: unlike a checkpoint, a table's size estimate is that of its files, and not the
    product of the estimates of all joins so far, whose digits double every round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), lambda: remove(spark, path)


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how) in which Spark may split a hot key's rows.

    AQE splits a skewed partition only if both sides come straight from a shuffle made for the
    join. The result of a grouping by the same keys does not, so its first key (a long) is
    joined by its complement, for which both sides are dealt anew.
    """
    key = "__split_" + on[0]
    left, right = left.withColumn(key, F.bitwise_not(on[0])), right.withColumn(key, F.bitwise_not(on[0])).drop(on[0])
    return left.join(right, [key, *on[1:]], how).drop(key)
