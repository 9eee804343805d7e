"""Numbered manifests in a folder: a name that is taken in one step is a commit."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """The number is taken: another writer has committed it."""


class Manifests:
    """JSON files named by numbers, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        if not self.files.exists(self.at("")):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.at(""))]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int):
        stream = self.files.open(self.at(str(number)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, told) -> None:
        """Write under a name of its own, then take the number's; one that is there is never replaced."""
        own = self.at(f".{number}-{self.jvm.java.util.UUID.randomUUID().toString()}")
        out = self.files.create(own)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if self.files.exists(self.at(str(number))) or not self.files.rename(own, self.at(str(number))):
            self.files.delete(own, False)
            raise Conflict(f"{number} in {self.path}")

    def remove(self, number: int) -> None:
        self.files.delete(self.at(str(number)), False)
