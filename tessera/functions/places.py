"""Places of rows in the order of a whole number, put together from buckets.

A bucket holds the rows of one group whose numbers agree but for the last ``SPAN_BITS`` bits, so it is bounded,
and a task orders a bucket, not a group. What crosses buckets is one row a bucket: a group may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_BITS = 16


def _carried(table: DataFrame, by: str, order: str, each: list[Column], over: list[Column], here: dict[str, Column]) -> DataFrame:
    """The rows with ``here``, windows by (by, _bucket), and ``over``, expressions of ``each``'s results a bucket."""
    rows = table.withColumn("_bucket", F.shiftright(order, SPAN_BITS))
    buckets = rows.groupBy(by, "_bucket").agg(*each).select(F.col(by).alias("_by"), F.col("_bucket").alias("_own"), *over)
    return rows.withColumns(here).join(buckets, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_own")))


def places(table: DataFrame, by: str, order: str, place: str, total: str) -> DataFrame:
    """With ``place`` from 0 in the order of ``order`` within ``by``, and the group's size ``total``."""
    size, inside = F.col("_size"), Window.partitionBy(by, "_bucket").orderBy(order)
    before = F.sum(size).over(Window.partitionBy(by).orderBy("_bucket")) - size
    over = [before.alias("_before"), F.sum(size).over(Window.partitionBy(by)).alias("_total")]
    rows = _carried(table, by, order, [F.count("*").alias("_size")], over, {"_place": F.row_number().over(inside) - 1})
    return rows.select(*table.columns, (F.col("_before") + F.col("_place")).alias(place), F.col("_total").alias(total))


def most_before(table: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """With ``name``, the largest ``value`` of the rows before in ``by``; null for the first."""
    rows = table.withColumn("_value", value)
    inside = Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = _carried(rows, by, order, [F.max("_value").alias("_most")], [F.max("_most").over(earlier).alias("_earlier")], {"_here": F.max("_value").over(inside)})
    return rows.select(*table.columns, F.greatest("_here", "_earlier").alias(name))
