"""Order over a whole table without one task that holds it.

A window without partitions puts all rows into one task. Here rows are dealt into ranges of
the order, each range is sorted for itself, and only the number of rows of each range goes
on; a row's place is its place in the range plus the rows of the ranges before. From places
follow neighbours (a join on the place less one), ranks and running totals (in blocks of
places, with the totals of the blocks before carried in).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.storage import stored

#: Rows of a block, in which running values are computed at a time.
BLOCK = 1 << 16
_RANGE, _AT = "__range", "__at"


def _ranges(df: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """The rows with the number of their range and their place in it, stored: ranges are sampled, and another evaluation could deal them otherwise."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranges.withColumns({_RANGE: F.spark_partition_id(), _AT: at}), "ranges")


def _with_starts(ranges: DataFrame, size: Column) -> DataFrame:
    """Next to each row, how much lies in the ranges before its own."""
    sizes = ranges.groupBy(_RANGE).agg(size.alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(_RANGE).alias("__r"), before.alias("__before"))
    return ranges.join(F.broadcast(starts), F.col(_RANGE) == F.col("__r")).drop("__r")


def numbered(df: DataFrame, *order: Column | str, name: str = "__place") -> DataFrame:
    """The rows with their place in an order, gapless from 0.

    The order should tell rows apart; equal rows get their places in any order, and ones too many for a task
    make a large range, so give a last key that differs.
    """
    rows = _with_starts(_ranges(df, order), F.count("*"))
    return rows.withColumn(name, F.col("__before") + F.col(_AT)).drop(_RANGE, _AT, "__before")


def placed(df: DataFrame, *order: Column | str, weight: str, name: str = "__place") -> DataFrame:
    """The rows with the sum of the weights (whole numbers) of all rows before them in an order that tells rows apart."""
    here = F.sum(weight).over(Window.partitionBy(_RANGE).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    rows = _with_starts(_ranges(df, order), F.sum(weight))
    return rows.withColumn(name, F.col("__before") + here).drop(_RANGE, _AT, "__before")
