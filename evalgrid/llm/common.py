"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a temporary folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def modest_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Has Spark hand texts to Python in batches of at most so many rows and bytes, unless the session asks for fewer.

    The usual 10,000 rows and 64 MB, held several times over in the JVM, Arrow and pandas by each
    worker, are too much for executors of a few gigabytes.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.sub(r"\D", "", str(spark.conf.get(key))))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again.

    This cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folders of a table that ``written`` gave, once nothing reads it any more; others are left alone."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if str(folder.getParent().toUri().getPath()).rstrip("/") == spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath().rstrip("/"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def mix32(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 32-bit integers (in place); shifts and odd multipliers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def remix32(x: np.ndarray) -> np.ndarray:
    """A second bijection of the 32-bit integers (in place), with other shifts and multipliers."""
    x ^= x >> np.uint32(17)
    x *= np.uint32(0xED5AD4BB)
    x ^= x >> np.uint32(11)
    x *= np.uint32(0xAC4C1B51)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x31848BAB)
    x ^= x >> np.uint32(14)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 64-bit integers (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Odd multipliers, one for each place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` words, given the words' 64-bit hashes."""
    if len(words) < n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        part = words[i : len(words) - n + 1 + i] * _PLACES[i % 5]
        out = mix64(out + part + np.uint64(i + 1))
    return out
