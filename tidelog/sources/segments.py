"""An event table as owner buckets of Parquet segments: a write appends rows, and names the ids that it takes away.

    root/rows/v=N/bucket=K    rows that version N added to bucket K
    root/gone/v=N/bucket=K    ids that version N took from bucket K, out of segments of lower versions
    root/manifest/N           which segments of either kind make version N

A version counts once its manifest is there. Buckets with many segments are rewritten as one, alone, so the work of a write
follows the batch and not the table. Paths go through Hadoop's file systems only. One writer at a time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


class Segments:
    #: Segments of a bucket beyond which a write rewrites it.
    MOST = 8

    def __init__(self, spark: SparkSession, root: str, schema: StructType, buckets: int = 64, keep: int = 2):
        self.spark, self.root, self.schema, self.buckets, self.keep = spark, root.rstrip("/"), schema, buckets, keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket_of(self, owner: Column) -> Column:
        return F.pmod(F.crc32(owner.cast("binary")), F.lit(self.buckets)).cast("int")

    def bucket_numbers(self, owners: Iterable[str]) -> list[int]:
        return sorted({zlib.crc32(o.encode()) % self.buckets for o in owners})

    def _list(self, sub: str) -> list[str]:
        p = self._path(f"{self.root}/{sub}")
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._list("manifest") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[str, list[list[int]]]:
        """rows and gone: (version, bucket) of the segments that make a version (default: the last one)."""
        found = self.versions()
        if not found:
            return {"rows": [], "gone": [], "buckets": self.buckets}
        text = self.spark.read.text(f"{self.root}/manifest/{found[-1] if version is None else version}").first()[0]
        return json.loads(text)

    def _read(self, kind: str, segments: list[list[int]], schema: StructType) -> DataFrame:
        full = StructType([*schema, StructField("v", IntegerType()), StructField("bucket", IntegerType())])
        if not segments:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.root}/{kind}/v={v}/bucket={b}" for v, b in segments]
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The current rows with their column bucket; only: of these buckets, no others are opened."""
        m = self.manifest()
        wanted = None if only is None else set(only)
        rows, gone = ([s for s in m[k] if wanted is None or s[1] in wanted] for k in ("rows", "gone"))
        out = self._read("rows", rows, self.schema)
        if gone:
            taken = self._read("gone", gone, StructType([StructField("id", StringType())])).select(F.col("id").alias("_i"), F.col("v").alias("_v"), F.col("bucket").alias("_b"))
            out = out.join(taken, (F.col("id") == F.col("_i")) & (F.col("bucket") == F.col("_b")) & (F.col("v") < F.col("_v")), "left_anti")
        return out.drop("v")

    def _write(self, kind: str, version: int, rows: DataFrame) -> list[list[int]]:
        """Writes rows (with bucket), large buckets in several files of sorted rows; the segments that came of it."""
        order = ["kind", "created_at"] if kind == "rows" else ["id"]
        rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.root}/{kind}/v={version}")
        return [[version, int(n[7:])] for n in self._list(f"{kind}/v={version}") if n.startswith("bucket=")]

    def _commit(self, version: int, manifest: dict, base: list[int]) -> None:
        if self.versions() != base:
            raise RuntimeError("another writer has changed the table meanwhile; this write is not in it")
        text = json.dumps(manifest | {"buckets": self.buckets})
        out = self._fs.create(self._path(f"{self.root}/manifest/_{version}"))
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(self._path(f"{self.root}/manifest/_{version}"), self._path(f"{self.root}/manifest/{version}"))
        old = self.versions()[: -self.keep]
        held = [self.manifest(v) for v in self.versions()[-self.keep :]]
        claims = [n for n in self._list("manifest") if n.startswith("claim-") and int(n[6:]) <= version]
        for name in [*map(str, old), *claims]:
            self._fs.delete(self._path(f"{self.root}/manifest/{name}"), True)
        for kind in ("rows", "gone"):
            used = {tuple(s) for m in held for s in m[kind]}
            for name in self._list(kind):
                own = [b for b in self._list(f"{kind}/{name}") if b.startswith("bucket=")]
                dead = [b for b in own if (int(name[2:]), int(b[7:])) not in used]
                for b in dead if len(dead) < len(own) else [""]:
                    self._fs.delete(self._path(f"{self.root}/{kind}/{name}/{b}".rstrip("/")), True)

    def _next(self) -> int:
        """A number above every version that was begun, ended or not; no other writer gets it."""
        begun = [int(n[2:]) for k in ("rows", "gone") for n in self._list(k) if n.startswith("v=")]
        begun += [int(n[6:]) for n in self._list("manifest") if n.startswith("claim-")]
        version = max([-1, *self.versions(), *begun]) + 1
        if not self._fs.createNewFile(self._path(f"{self.root}/manifest/claim-{version}")):
            raise RuntimeError("another writer is at work")
        return version

    def change(self, add: DataFrame | None = None, take: DataFrame | None = None) -> None:
        """Appends rows (with owner) and takes away the ids of `take` (id, bucket) that stood before."""
        base, m, version = self.versions(), self.manifest(), self._next()
        if m.get("buckets", self.buckets) != self.buckets:
            raise ValueError(f"this table has {m['buckets']} buckets")
        if take is not None:
            m["gone"] += self._write("gone", version, take.select("id", "bucket").distinct())
        if add is not None:
            m["rows"] += self._write("rows", version, add.withColumn("bucket", self.bucket_of(F.col("owner"))).select(*self.schema.names, "bucket"))
        self._commit(version, m, base)
        count: dict[int, int] = {}
        for kind in ("rows", "gone"):
            for _, b in m[kind]:
                count[b] = count.get(b, 0) + 1
        self.compact([b for b, n in count.items() if n > self.MOST])

    def compact(self, buckets: Iterable[int]) -> None:
        """Rewrites each of these buckets as one segment."""
        wanted = set(buckets)
        if not wanted:
            return
        self.replace(self.read(wanted), wanted)

    def replace(self, rows: DataFrame, buckets: Iterable[int]) -> None:
        """These buckets hold `rows` (of them, with owner) from now on, all others what they held."""
        wanted, base, m, version = set(buckets), self.versions(), self.manifest(), self._next()
        rest = {k: [s for s in m[k] if s[1] not in wanted] for k in ("rows", "gone")}
        rest["rows"] += self._write("rows", version, rows.withColumn("bucket", self.bucket_of(F.col("owner"))).select(*self.schema.names, "bucket"))
        self._commit(version, rest, base)
