"""Tables in the folder that the driver and all executors share: what is read twice is written once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master may name none, and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'lodestar-shared')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    _, at, system = hadoop(spark, path)
    system.deleteOnExit(at)
    return path


def hadoop(spark: SparkSession, path: str):
    """``(JVM, Hadoop path, file system)`` of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: a lost executor costs a re-read, and what is read again is not worked out again."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
