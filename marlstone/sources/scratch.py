"""Tables in the folder that all executors share, to cut lineage or to hold a stream's output."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of the driver gets a local
    folder; on a cluster that is an error, since every executor would write to its own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set, and executors of {master} share no other folder")
        at = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The local path of one in the shared folder, where every machine mounts that; an error for other stores."""
    if not re.match("file:|/", path):
        raise ValueError(f"{path} is in no folder that machines mount")
    return re.sub("^file:/*", "/", path)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, and the files stay compressed.
    """
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, older_than: float = 86_400) -> int:
    """Remove this library's tables in the shared folder that were begun so many seconds ago or more; how many went.

    A result is read when it is used, so no query calls this for itself: run it when none
    is open that began before.
    """
    jvm, root = spark.sparkContext._jvm, shared_dir(spark)
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = (time.time() - older_than) * 1000
    old = [f.getPath() for f in (files.listStatus(folder) if files.exists(folder) else []) if re.search("-[0-9a-f]{32}$", f.getPath().getName()) and f.getModificationTime() <= last]
    return sum(files.delete(p, True) for p in old)
