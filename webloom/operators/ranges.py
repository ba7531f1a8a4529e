"""Rows dealt over ranges of a composite order, so that work in that order runs range by range.

Ranges are cut on all columns of the order, ties included, so a value that holds a third of all rows spans a third
of the ranges. What a range needs from those before it is one small row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.sources.tables import materialised

RANGE = "__range"


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df``, written once, and the number of each row's range (``__range``): a row of a lower range is never behind one of a higher.

    It is written, since the cuts come from a sample and would be others if they were drawn again. Spark's number of
    shuffle partitions is that of the ranges.
    """
    return materialised(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))
