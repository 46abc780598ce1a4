"""Ranks within groups of any size: range partitions in order, and sums of their sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.sources.shared import kept

#: Bits that Spark's increasing ids leave for the place within a partition.
_PLACE = (1 << 33) - 1


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place from 1 of each row within its group, by an order that leaves no ties open.

    Rows are dealt to range partitions of the group and the order, so a large group lies in several. A row's rank is its
    place in its partition and the sum of the group's rows in the partitions before it: no task holds a group. Null keys are a group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    at = F.monotonically_increasing_id()
    placed = kept(dealt.withColumns({"__part": F.spark_partition_id(), "__at": at.bitwiseAND(F.lit(_PLACE))}), "ranked")
    sizes = placed.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition and group
    bases = sizes.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__base"))
    same = [F.col("__part") == F.col("__p"), *(F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by))]
    return placed.join(bases, same).select(*df.columns, (F.col("__at") + F.col("__base")).alias(name))
