"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of this machine only where none is set, as in tests."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder()).rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lodestone-")


def unique() -> str:
    return uuid.uuid4().hex


def kept(df):
    """The rows of ``df``, written to the shared folder as Parquet and read from there: planned and run once.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{unique()}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
