"""Places of rows inside ordered groups, without one task per group.

Rows are dealt by range of (group, order) and sorted where they lie; what a group has in
each range is counted, and running sums of these few counts give every range its first
place. A group with a third of all rows, or one row repeated that often, is spread over as
many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintry.llm.columns import stored

_ROW, _AT, _RANGE = "__row", "__at", "__range"
# monotonically_increasing_id() holds the partition above this bit and the row below it.
_ROW_BITS = 33


def sorted_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by range of ``keys`` (nulls first) and sorted in each range.

    The row's place in its input splits rows that are alike in all keys.
    """
    ascending = [F.col(c).asc_nulls_first() for c in (*keys, _ROW)]
    numbered = df.withColumn(_ROW, F.monotonically_increasing_id())
    return numbered.repartitionByRange(*ascending).sortWithinPartitions(*ascending).drop(_ROW)


def positions(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``position`` (from 0, in ``order``) and ``group_rows``; group columns are not null.

    Rows alike in all of ``order`` get neighbouring places in no stated order.
    """
    kept = stored(sorted_ranges(df, [*group, *order]).withColumn(_AT, F.monotonically_increasing_id()))
    ranged = kept.withColumn(_RANGE, F.shiftright(_AT, _ROW_BITS))
    runs = ranged.groupBy(*group, _RANGE).agg(
        F.min(_AT).alias("__first"), F.count("*").alias("__rows")
    )
    whole = Window.partitionBy(*group)
    before = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *group, _RANGE,
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(whole).alias("group_rows"),
    )
    placed = ranged.join(starts, [*group, _RANGE])
    return placed.withColumn("position", F.col(_AT) + F.col("__shift")).drop(_AT, _RANGE, "__shift")
