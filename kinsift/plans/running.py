"""Running sums and numbers over a whole table without one task that holds it: by ranges, each summed, then carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.plans.lineage import materialize


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all rows up to each, in the order given, its own included; equal rows are told apart somehow.

    The ranges' sums, a row a partition, are the only rows that meet in one task.
    """
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(_plain(order))} | {"_value": value})
    by = [_directed(F.col(f"_o{i}"), c) for i, c in enumerate(order)]
    dealt = materialize(keyed.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    # a row a partition
    joined = dealt.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + own)
    return joined.select(*df.columns, name)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 1, 2, 3 ... in the order given."""
    return running_sum(df, order, F.lit(1), name)


class Down:
    """A column to be ordered from the greatest down."""

    def __init__(self, column: Column):
        self.column = column


def _plain(order: list) -> list[Column]:
    return [c.column if isinstance(c, Down) else c for c in order]


def _directed(column: Column, said) -> Column:
    return column.desc() if isinstance(said, Down) else column.asc()
