"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str = "tables") -> str:
    """A new folder in spark.checkpoint.dir where that is set, else of this machine (a local master only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: later joins know its size, and lost executors don't compute it again."""
    path = f"{scratch_folder(df.sparkSession, name)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that settled wrote and nothing reads any more."""
    for table in tables:
        hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
