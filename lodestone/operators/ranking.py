"""Ranks and running sums over all rows without one task that sees all of them.

Rows are dealt by ranges of the order and written, so that a part stays what it is;
each part's sum comes to the driver (a number a part), and what lies before a part
is added to a sum inside it.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written


def running(rows: DataFrame, order: list[str], value: Column, name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (whole numbers) over the rows before it in ``order`` (nulls first).

    Rows that are equal in ``order`` come in any order; let its last column be unique where that matters.
    """
    dealt = written(rows.withColumn("_value", value.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.sum("_value").alias("n")).collect())
    before = dict(zip((p for p, _ in sums), accumulate((n for _, n in sums), initial=0), strict=False))
    offsets = dealt.sparkSession.createDataFrame(list(before.items()), "_part int, _offset long")
    own = F.coalesce(F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row a part, and parts are bounded by the session's number of partitions.
    return dealt.withColumn(name, own).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset", "_value")


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with ``name``: their number (from 0) in ``order``."""
    return running(rows, order, F.lit(1), name)
