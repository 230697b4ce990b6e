"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A single file of more bytes than this is spread over the cores, as one reader would keep them idle.
SPREAD_BYTES = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; its columns are pruned by whoever selects from it.

    A table of many files is read as it lies.  One that is a single file has but one reader as a rule (one row
    group): its rows are dealt to all cores first.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    files = df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if len(files) == 1 and cores > 1:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
        size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if size > SPREAD_BYTES:
            return df.repartition(cores)
    return df
