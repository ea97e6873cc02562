"""Shared building blocks: durable checkpoints, grouped prefix sums, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and Python spelling of "a run of anything but ASCII white space".
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of an Arrow batch of texts. With Spark's 64 MB a task's texts are one batch, which the JVM and Python hold several times each.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; a temporary one only on a single machine."""
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame, files: int | None = None) -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage ends there, so a lost executor costs only its own tasks,
    and its real size is known to the planner. Released by `release`, or when the driver ends. files: the most files it is written to (for tables that take little work)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) for rows that hold texts: in batches that end with the row that passes BATCH_BYTES, and with
    the memory that a task has freed given back, as the worker lives on. The session's batch size, which Spark reads when the
    result is run, is lowered for that and stays so; a lower one is kept."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the worker's last task held to its end
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc
        trim(0)


def files_for(rows: int, each: int = 250_000, least: int = 8) -> int:
    """The most files for a table of so many rows, of which `each` are worth a file and a task: narrow ones by default, fewer
    where a row takes work (`row_files`)."""
    return least + rows // each


def row_files(rows: int) -> int:
    """The most files for a table whose rows each take the work of a text."""
    return files_for(rows, 20_000, 24)


def release(*tables: DataFrame) -> None:
    """Delete the files of durable tables that are not read any more."""
    for df in tables:
        spark = df.sparkSession
        _file_system(spark, df._durable_path).delete(spark._jvm.org.apache.hadoop.fs.Path(df._durable_path), True)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def unit_interval(hashed: Column) -> Column:
    """A signed 64-bit hash as a double in [0, 1), ordered as the unsigned hash."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def unsigned_order(hashed: Column) -> Column:
    """Maps a signed 64-bit hash to a long whose signed order is the unsigned order."""
    return hashed.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def grouped_prefix(
    df: DataFrame, group: str, key: str, ties: list[str], value: Column, out: str, rows: int, rows_per_bucket: int = 8192
) -> DataFrame:
    """Exclusive running sum of `value` inside each `group`, in the order of the hash `key`.

    The hash range of each group is cut into equal buckets of about `rows_per_bucket` rows, so that a group
    with a third of all rows is spread over many tasks; bucket totals are summed in a second, small window.
    Needs a non-null `group`; `rows` is the row count of df.
    """
    n = max(1, -(-rows // rows_per_bucket))
    b = df.withColumn("__bucket", F.floor(unit_interval(F.col(key)) * n).cast("long")).withColumn("__value", value)
    totals = b.groupBy(group, "__bucket").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start")
    )
    inside = (
        Window.partitionBy(group, "__bucket")
        .orderBy(unsigned_order(F.col(key)), *[F.col(t).asc_nulls_last() for t in ties])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    run = b.withColumn("__inner", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return (
        run.join(starts, (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(out, F.col("__start") + F.col("__inner"))
        .drop("__bucket", "__value", "__g", "__b", "__start", "__inner")
    )
