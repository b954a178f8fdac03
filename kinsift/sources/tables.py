"""Tables by name, dealt evenly where they are small and of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table from which on it is read as its files lie, and below which it is not worth dealing out.
LARGE, TINY = 64 << 20, 128 << 10


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores is dealt out before it is worked on: a file of one row group would be one task.

    What is shuffled is bounded by LARGE; larger tables, and those of many files, are read as they lie.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if TINY <= size <= LARGE and len(df.inputFiles()) < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
