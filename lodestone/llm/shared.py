"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of this machine only where none is set, as in tests."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder()).rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lodestone-")


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as Parquet to the shared folder and read from there.

    That cuts the lineage: a lost executor costs no more than a new read. What isn't ``removed`` goes
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/lodestone-" in file:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
