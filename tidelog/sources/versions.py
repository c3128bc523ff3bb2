"""A table as numbered Parquet versions; the highest committed one is current. Plain Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Versions:
    """Versions live in `root/v=N`; a version counts once Spark's committer has left its _SUCCESS. Paths go through
    Hadoop's file systems only, so any store that Spark reads will do. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keep: int = 2):
        self.spark, self.root, self.schema, self.keep = spark, root.rstrip("/"), schema, keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.numbers()
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.root}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> DataFrame:
        found = self.numbers()
        new = found[-1] + 1 if found else 0
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/v={new}")
        for old in found[: len(found) + 1 - self.keep]:
            self._fs.delete(self._path(f"{self.root}/v={old}"), True)
        return self.read()
