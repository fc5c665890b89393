"""Intermediate tables as Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from finstrata.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet; nothing is created."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back with the same schema: cuts lineage, survives lost executors, keeps column pruning and pushdown."""
    return land_at(df, new_folder(df.sparkSession, name))


def land_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder through Spark's file system layer. The caller has landed everything that was built on it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_landed(df: DataFrame) -> None:
    """Delete a table that ``land`` returned."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        drop(df.sparkSession, folder)
