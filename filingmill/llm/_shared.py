"""Where intermediate tables go, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch of rows sent to Python ends at this many bytes (long texts) or rows, whichever comes first.
BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 4096
#: A table is broadcast only if it is known to have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one process may
    it be unset, and a folder of our own is taken."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="filingmill-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _hadoop_path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _hadoop_path(spark, at)
    files.deleteOnExit(path)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors lose none of it, and lineage ends here. The
    shuffle files of the plan that wrote it are no longer needed, and Spark is told so."""
    spark = df.sparkSession
    at = scratch_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that no plan still to be run reads."""
    for table in tables:
        path, files = _hadoop_path(table.sparkSession, table._staged_at)
        files.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a stored table, to be broadcast if it is known to be of at most so many rows and bytes (strings and arrays by
    their length); else as it is."""
    wide = [F.octet_length(c) if t == "string" else F.size(c) * 8 for c, t in df.dtypes if t == "string" or t.startswith("array")]
    each = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(df.columns)))
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not add up in a Python worker. Every operator sets the
    same two values; operators that need less at a time cut the batches themselves (`cut_batches`)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` (strings) has about `most` bytes."""
    for batch in batches:
        sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        part = np.cumsum(sizes) // most
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(sizes)) if len(sizes) else [0]
        at = 0
        for end in ends:
            yield batch.slice(at, int(end) - at)
            at = int(end)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """128 bits that name a text: two differently salted 64-bit hashes. Null for null."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("key"), text).alias("b")))
