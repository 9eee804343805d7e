"""Tables that come in fewer pieces than the session has cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, dealt to all cores if fewer pieces of it hold rows than there are cores.

    Parquet is not split within a row group, so that a file of one is a single task however
    large it is. The pieces are counted by the files' footers; a table of as many pieces as
    cores or more stays as it is and is not shuffled. Rows stay the same, their order does not.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("piece")).distinct().count()
    return df.repartition(cores) if 0 < held < cores else df
