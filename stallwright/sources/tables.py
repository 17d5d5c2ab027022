"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files; columns are pruned by the plan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fingerprint(spark: SparkSession, folder: str, name: str) -> str:
    """Names, sizes and times of a table's files: equal as long as nothing was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(where)))
