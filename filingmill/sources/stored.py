"""Tables that are kept as files and changed in place: upserts that read and replace only the partitions a change touches, global
numbers for sorted rows, and a place for intermediate tables.

A keyed table lies in `buckets` partitions by a hash of its key. An upsert reads the buckets of its changes, merges, and lets Spark's own dynamic
partition overwrite replace just these; files of all other buckets stay as they are. Spark writes to a staging folder first, so a job that
fails leaves the old rows. The commit replaces one bucket after another and is not atomic over all of them; only one writer at a time
may change a table."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BUCKET, BUCKETS = "_bucket", 64


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


def hadoop_path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = hadoop_path(spark, at)
    files.deleteOnExit(path)
    return at


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, stored once in the shared folder and read back, where several branches of a plan read it."""
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _bucketed(rows: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """With the bucket, and its rows together, so that a bucket is a file or a few."""
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _written(rows: DataFrame, path: str, mode: str) -> None:
    # Rebalancing splits a bucket that is too large for one task and joins small ones' tasks.
    rows.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _about(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_about").first()[0])


def key_of(spark: SparkSession, path: str) -> list[str]:
    return _about(spark, path)["key"]


def create(rows: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
    """A new keyed table of rows (one a key). Comments of columns (see `commented`) are kept with it."""
    schema = json.loads(rows.schema.json())
    _written(_bucketed(rows, key, buckets), path, "errorifexists")
    about = json.dumps({"key": list(key), "buckets": buckets, "schema": schema})
    rows.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/_about")


def read(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """A keyed table, its columns and their comments as they were created; of `buckets` only, so that no other file is opened."""
    schema = StructType.fromJson(_about(spark, path)["schema"])
    found = spark.read.schema(StructType([*schema.fields, StructField(BUCKET, StructType.fromDDL("x int")[0].dataType)])).parquet(path)
    if buckets is not None:
        found = found.filter(F.col(BUCKET).isin([int(b) for b in buckets]))
    return found.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields))


def upsert_into(path: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets that the changes' keys fall into by merge(their rows, changes). Returns these buckets. A merge that gives a row a
    key of another bucket is an error."""
    spark = changes.sparkSession
    about = _about(spark, path)
    key, buckets = about["key"], about["buckets"]
    touched = sorted(r[0] for r in _bucketed(changes.select(*key), key, buckets).select(BUCKET).distinct().collect())  # at most `buckets`
    if not touched:
        return []
    current = read(spark, path, touched)
    merged = _bucketed(merge(current, changes).select(*current.columns), key, buckets)
    fits = F.col(BUCKET).isin(touched)
    checked = merged.withColumn(BUCKET, F.when(fits, F.col(BUCKET)).otherwise(F.raise_error(F.lit("a merged row has a key of another bucket")).cast("int")))
    _written(checked, path, "overwrite")
    return touched


def delete_from(path: str, keys: DataFrame) -> list[int]:
    """Remove the rows of these keys; nulls equal nulls. A bucket that becomes empty keeps no rows."""
    spark = keys.sparkSession
    key = _about(spark, path)["key"]

    def without(current: DataFrame, gone: DataFrame) -> DataFrame:
        gone = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in key))
        same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in key]
        return current.join(gone, same, "left_anti")

    found = _bucketed(keys.select(*key), key, _about(spark, path)["buckets"])
    touched = sorted(r[0] for r in found.select(BUCKET).distinct().collect())
    left = _bucketed(without(read(spark, path, touched), keys), key, _about(spark, path)["buckets"])
    still = {r[0] for r in left.select(BUCKET).distinct().collect()}
    if still:
        _written(left, path, "overwrite")
    for bucket in set(touched) - still:  # a partition without rows is not overwritten by Spark
        at, files = hadoop_path(spark, f"{path}/{BUCKET}={bucket}")
        files.delete(at, True)
    return touched


def commented(rows: DataFrame, comments: dict[str, str]) -> DataFrame:
    """rows whose columns carry comments, as metadata that stored tables keep."""
    return rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata | ({"comment": comments[f.name]} if f.name in comments else {})) for f in rows.schema.fields))


def numbered(rows: DataFrame, by: str | Sequence[str], after: Column | int, name: str) -> DataFrame:
    """rows with name: after + 1, after + 2, ... in the order of `by`. The rows are sorted into a table of ranges by Spark's own sampling; a
    row's number is its place in its file plus the rows of the files before, so no task sees more than one range and the files' counts
    alone (one a task) meet on the driver. Equal values of `by` are numbered in any order, once and for all, as the table is stored."""
    spark = rows.sparkSession
    at = scratch_path(spark, "numbered")
    rows.orderBy(*([by] if isinstance(by, str) else by)).write.parquet(at)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    stored = spark.read.schema(rows.schema).parquet(at).select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = sorted(stored.groupBy("_file").count().collect())
    starts, total = [], 0
    for n, count in counts:
        starts.append((n, total))
        total += count
    begin = F.broadcast(spark.createDataFrame(starts, "_file int, _start long"))
    number = (F.col("_start") + F.col("_row") + 1 + (F.lit(after) if isinstance(after, int) else after)).cast("long")
    return stored.join(begin, "_file").withColumn(name, number).drop("_file", "_row", "_start")
