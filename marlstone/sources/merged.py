"""Keyed tables that change a part at a time: merge on read, compaction, removal of what no version names.

A table is a folder of data, in buckets of keys, and of manifests. A change writes its rows
as a delta of the buckets that they fall into, and then one manifest, which names for each
bucket the deltas that make it; taking the manifest's name is the commit. Readers take the
last manifest: buckets of one delta are read as they are, the others merged by key. A bucket
that has gathered many deltas is written anew by the change that finds it so, alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sources.manifests import Manifests

#: Deltas of a bucket from which on a change writes it anew.
MOST_DELTAS = 4


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.most = spark, path.rstrip("/"), schema, list(keys), buckets, most_deltas
        self.manifests = Manifests(spark, f"{self.path}/manifests")
        self.files = self.manifests.files
        self.whole = T.StructType([*schema.fields, T.StructField("__version", T.LongType()), T.StructField("__gone", T.BooleanType())])

    def versions(self) -> list[int]:
        return self.manifests.numbers()

    def manifest(self, version: int | None = None) -> dict[int, list[int]]:
        """Bucket -> versions of its deltas, the oldest first."""
        found = self.versions()
        if version is None and not found:
            return {}
        return {int(b): v for b, v in self.manifests.read(found[-1] if version is None else version).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def folders(self, told: dict[int, list[int]]) -> list[str]:
        return [f"{self.path}/data/{v}/bucket={b}" for b, versions in told.items() for v in versions]

    def load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.whole).parquet(*folders) if folders else self.spark.createDataFrame([], self.whole)

    def merged(self, told: dict[int, list[int]]) -> DataFrame:
        rest = [c for c in self.whole.names if c not in self.keys]
        return self.load(self.folders(told)).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__version").alias("row")).select(*self.keys, "row.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last."""
        told = self.manifest(version)
        single = self.load(self.folders({b: v for b, v in told.items() if len(v) == 1}))
        several = {b: v for b, v in told.items() if len(v) > 1}
        rows = single.select(*self.whole.names).unionByName(self.merged(several)) if several else single
        return rows.where("not __gone").select(*self.schema.names)

    def change(self, rows: DataFrame, gone: bool) -> int:
        """Add a version with these rows' keys set or gone; of several rows of a key any counts. Returns its number."""
        told, version = self.manifest(), max(self.versions(), default=-1) + 1
        new = rows.dropDuplicates(self.keys).withColumns({"__version": F.lit(version).cast("long"), "__gone": F.lit(gone), "bucket": self.bucket()})
        self.write(new, version)
        touched = sorted(int(f.getPath().getName().removeprefix("bucket=")) for f in self.listed(f"data/{version}") if f.getPath().getName().startswith("bucket="))
        for b in touched:
            told[b] = [*told.get(b, []), version]
        full = {b: told[b] for b in touched if len(told[b]) > self.most}
        if full:
            # those buckets alone are read and written anew, beside the delta, under a number that no change has
            anew = -version - 1
            self.write(self.merged(full).where("not __gone").withColumn("bucket", self.bucket()), anew)
            there = {int(f.getPath().getName().removeprefix("bucket=")) for f in self.listed(f"data/{anew}") if f.getPath().getName().startswith("bucket=")}
            for b in full:
                told[b] = [anew] if b in there else []
        self.manifests.commit(version, {b: v for b, v in told.items() if v})
        return version

    def write(self, rows: DataFrame, version: int) -> None:
        rows.select(*self.whole.names, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")

    def listed(self, name: str) -> list:
        folder = self.manifests.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return list(self.files.listStatus(folder)) if self.files.exists(folder) else []

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of their keys, others are added."""
        return self.change(rows.select(*self.schema.names), False)

    def delete(self, keys: DataFrame) -> int:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
        return self.change(keys.select(*self.keys, *rest).select(*self.schema.names), True)

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the last ``keep``, and the data that none of those names; how many folders went. No reader may use older versions, no writer be at work."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.manifests.remove(v)
        named = {f for v in versions[-keep:] for f in self.folders(self.manifest(v))}
        gone = 0
        for data in self.listed("data"):
            for f in self.listed(f"data/{data.getPath().getName()}"):
                at = f"{self.path}/data/{data.getPath().getName()}/{f.getPath().getName()}"
                if f.getPath().getName().startswith("bucket=") and at not in named:
                    gone += self.files.delete(f.getPath(), True)
        return gone
