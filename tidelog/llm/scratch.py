"""Shared helpers: column access that survives clashing names, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType


#: Rows of an Arrow batch, where the session sets none: whole texts of some MB at once bound a Python worker's memory.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def frugal(df: DataFrame) -> DataFrame:
    """df; its session uses small Arrow batches from now on, unless it has a setting of its own."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df


def take(df: DataFrame, **cols: str) -> DataFrame:
    """Columns of df by exact (case-sensitive) name under new names: take(df, id="doc_id").

    Other columns, even ones that differ only in case or that repeat a new name, do no harm.
    """
    names = frugal(df).columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in cols.items()])


def local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver as a frame. They go to the JVM as Arrow: createDataFrame() of a list is a job of Python
    workers, for which each executor starts a second daemon that stays with its workers beside those of Arrow functions."""

    def plain(kind: DataType, x: Any) -> Any:
        if isinstance(kind, ArrayType) and x is not None:
            return [plain(kind.elementType, e) for e in x]
        if isinstance(kind, StructType) and x is not None:
            return {f.name: plain(f.dataType, e) for f, e in zip(kind, x, strict=True)}
        return x

    schema = StructType.fromDDL(ddl)
    if not rows:
        return spark.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)
    cols = [pa.array([plain(f.dataType, r[i]) for r in rows], arrow.field(i).type) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(cols, schema=arrow), schema)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Cut tables of this driver; they outlive the frames that read them, and go by forget() or when the driver ends.
_written: list[str] = []


@atexit.register
def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            forget(spark)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as Parquet to the shared folder and read back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables have been cut so far, for forget()."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, keep: int | None = None) -> None:
    """Delete cut tables number `since` up to `keep`; their consumers must have been written out before."""
    jvm = spark.sparkContext._jvm
    for i in range(since, len(_written) if keep is None else keep):
        if _written[i]:
            path = jvm.org.apache.hadoop.fs.Path(_written[i])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written[i] = ""


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; it steers the number of buckets only, never the result."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def buckets(df: DataFrame, bytes_each: int) -> int:
    """A bucket count that grows with the scanned bytes, and is at least two for each core."""
    n = -(-scan_bytes(df) // bytes_each)
    return int(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(n, 1 << 28)))


def hash_unit(*cols: Column) -> Column:
    """A number in (0, 1) from a 64-bit hash of cols."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


#: Bytes in memory of a side that is broadcast at most.
BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows, measured here, take `most` bytes at most, else as it is: Spark then joins by a
    shuffle. Only for cut tables: they are read for that."""
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    each = F.lit(48 + 16 * len(df.columns)).cast("long")
    for c in wide:
        each = each + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    for c, kind in df.dtypes:
        if kind.startswith(("array", "struct", "map")):
            each = each + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= most else df
