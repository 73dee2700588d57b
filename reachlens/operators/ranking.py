"""Places of rows within groups of any size, without a window over a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachlens.session import materialize


def ranked(df: DataFrame, group: str, order: Sequence[str], rank: str = "rank") -> DataFrame:
    """``df`` with the place of each row in its group, from 0, in ascending order of the columns, nulls first.

    Rows are range-partitioned by group and order and sorted where they lie, so a large group spreads over many partitions.
    A row's place is its place in its partition plus the rows that its group has in the partitions before; the
    latter come from one count per group and partition. Rows that are equal in all named columns must not occur.
    """
    parted = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    seated = materialize(parted.withColumn("__seat", F.monotonically_increasing_id()), "ranked")
    seated = seated.withColumn("__part", F.shiftrightunsigned("__seat", 33))
    own = seated.groupBy(group, "__part").agg(F.min("__seat").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).drop("__rows")
    place = F.col("__seat") - F.col("__first") + F.col("__before")
    return seated.join(starts, [group, "__part"]).withColumn(rank, place).drop("__seat", "__part", "__first", "__before")
