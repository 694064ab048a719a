"""Global order without a global window: positions, ranks and prefix sums over range partitions.

A window without a partition key sorts all rows in one task. Here rows are range-partitioned and sorted, written once
(the ranges' bounds are sampled), and what lies before each partition comes from a table of one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize

_PART, _AT = "__part", "__at"


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return materialize(rows).withColumn(_PART, F.shiftrightunsigned("__id", 33)).withColumn(_AT, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with the 0-based position of each row in ``order``."""
    rows = _ranges(df, list(order))
    ahead = rows.groupBy(_PART).agg(F.count("*").alias("n"))
    ahead = ahead.select(_PART, F.coalesce(F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    return rows.join(F.broadcast(ahead), _PART).withColumn(name, F.col("__ahead") + F.col(_AT)).drop(_PART, _AT, "__ahead")


def with_group_position(df: DataFrame, group: str, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with each row's 0-based position within ``group``; a group may span many partitions. Groups are few."""
    rows = with_position(df, F.col(group), *order, name="__p")
    start = rows.groupBy(group).agg(F.min("__p").alias("__s"))
    return rows.join(start, group).withColumn(name, F.col("__p") - F.col("__s")).drop("__p", "__s")


def running_sum(df: DataFrame, value: str, *order: Column, name: str = "running") -> DataFrame:
    """``df`` with its 0-based ``position`` and the inclusive running sum of ``value`` in ``order``."""
    rows = _ranges(df, list(order))
    sums = rows.groupBy(_PART).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(_PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__s"))
    own = F.sum(value).over(Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__own", own).join(F.broadcast(sums), _PART)
    return rows.withColumn("position", F.col("__n") + F.col(_AT)).withColumn(name, F.col("__s") + F.col("__own")).drop(_PART, _AT, "__own", "__n", "__s")
