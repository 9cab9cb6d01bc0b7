"""Row numbers and running sums of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.session import maybe_broadcast, spill


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str | None, name: str) -> DataFrame:
    """``name``: the sum of ``value`` (None: 1) over the rows of the group up to and with this one.

    Rows are range-partitioned by group and order, so a group that holds a third of all rows spreads over many tasks;
    the sums of the pieces give each piece its offset. ``order`` should be total. Null groups are a group.
    """
    x = F.lit(1) if value is None else F.col(value)
    cut = spill(df.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id()), "ranged")
    sizes = cut.groupBy(*group, "_piece").agg(F.sum(x).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*group, F.lit(0)).orderBy("_piece")) - F.col("_n")).withColumnRenamed("_piece", "_p2")  # one row per piece
    before = before.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_p2", "_before")
    on = F.col("_piece") == F.col("_p2")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = F.sum(x).over(W.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return cut.withColumn("_rn", inner).join(maybe_broadcast(before), on).withColumn(name, F.col("_rn") + F.col("_before")).select(*df.columns, name)


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """``name``: the row's number within its group, from 1 (see :func:`running_sum`)."""
    return running_sum(df, group, order, None, name)
