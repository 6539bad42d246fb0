"""Results that are used more than once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """df, computed once: a checkpoint where the session names a folder for these (spark.checkpoint.dir), otherwise a cache that
    executors hold and that is computed again where one is lost."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)
