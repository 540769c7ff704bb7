"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder with one Parquet file or directory per table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that is heavy per row.

    A table of one small file is read by one task. Tables of many files, as on a cluster, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def state_of(spark: SparkSession, folder: str, name: str) -> tuple[str, int, int, int]:
    """Path, bytes, files and time of the last change of a table: equal as long as its files are the same."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getContentSummary(file)
    return path, size.getLength(), size.getFileCount(), system.getFileStatus(file).getModificationTime()
