"""As-of and range joins without nested loops.

An as-of join is one sort: both sides are put in one table and the last row of the
right side is carried forward.  Time (or address) is cut into buckets, so a key
with a third of all rows, or no key at all, isn't one task: every bucket starts
from the last right row of an earlier bucket, which is found on one row a bucket.

Range joins get an equi-join on (key, bucket): intervals are exploded to the buckets
they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import numbered
from lodestone.session import written


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, bucket: Column | None = None, tie: str | None = None) -> DataFrame:
    """Every row of left and, as struct ``match``, the row of right with the greatest ``on`` that isn't beyond its own.

    ``bucket``: an expression that doesn't fall as ``on`` rises; ``tie``: a column of right whose
    largest value wins among rows with the same ``on``.
    """
    by = by or []
    bucket = F.lit(0) if bucket is None else bucket
    order = ["_on", "_side", "_tie"]
    rows_l = left.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"), bucket.alias("_bucket"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(F_struct(right)).alias("match"))
    rows_r = right.select(*by, F.col(on).alias("_on"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"), bucket.alias("_bucket"), F.lit(None).cast(F_struct(left)).alias("_left"), F.struct(*right.columns).alias("match"))
    last = rows_r.groupBy(*by, "_bucket").agg(F.max_by("match", F.struct("_on", "_tie")).alias("_last"))
    # A row for each key and bucket, those with left rows only as well.
    every = rows_l.select(*by, "_bucket").union(rows_r.select(*by, "_bucket")).distinct()
    carried = every.join(last, [*by, "_bucket"], "left").withColumn("_carry", F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    here = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows_l.unionByName(rows_r).withColumn("match", F.last("match", ignorenulls=True).over(here)).where("_side = 1")
    return found.join(carried, [*by, "_bucket"], "left").select("_left.*", F.coalesce("match", "_carry").alias("match"))


def asof_all(left: DataFrame, sides: dict[str, DataFrame], on: str, bucket: Column | None = None) -> DataFrame:
    """Every ``on`` of left once (nulls go) and, as a struct by name, the last row of each side that isn't beyond it.

    ``sides``: name -> rows (on, a struct of that name), one for each ``on``; ``bucket`` as above.  All go through
    one shuffle and one sort, however many sides there are.
    """
    bucket = F.lit(0) if bucket is None else bucket
    kinds = {name: rows.schema[name].dataType for name, rows in sides.items()}

    def columns(own: str | None = None) -> list[Column]:
        return [bucket.alias("_bucket"), F.col(on).alias("_on"), F.lit(0 if own else 1).alias("_side"), *((F.col(n) if n == own else F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items())]

    rows = left.where(F.col(on).isNotNull())
    spine = rows.select(bucket.alias("_bucket")).distinct()
    both = rows.select(*columns())
    for name, side in sides.items():
        own = side.where(F.col(on).isNotNull())
        both = both.unionByName(own.select(*columns(name)))
        last = own.groupBy(bucket.alias("_bucket")).agg(F.max_by(name, on).alias(name))
        spine = spine.unionByName(last, allowMissingColumns=True)
    # A row a bucket: what the buckets before it end with.
    ends = spine.groupBy("_bucket").agg(*(F.first(n, ignorenulls=True).alias(n) for n in sides))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_bucket", *(F.last(n, ignorenulls=True).over(before).alias(f"_{n}") for n in sides))
    order = Window.partitionBy("_bucket").orderBy("_on", "_side")
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    again = F.coalesce((F.lag("_on").over(order) == F.col("_on")) & (F.lag("_side").over(order) == 1), F.lit(False))
    found = both.select("_bucket", "_on", "_side", *(F.last(n, ignorenulls=True).over(here).alias(n) for n in sides), again.alias("_again")).where("_side = 1 AND NOT _again")
    return found.join(carry, "_bucket", "left").select(F.col("_on").alias(on), *(F.coalesce(n, f"_{n}").alias(n) for n in sides))


def F_struct(df: DataFrame):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields)


def nearest_symbol(addresses: DataFrame, symbols: DataFrame, bucket: Column | None = None) -> DataFrame:
    """addresses (address) as-of symbols (address, name, line_no): address above 0, the first-listed symbol of each address."""
    first = symbols.where("address > 0").groupBy("address").agg(F.min_by("name", "line_no").alias("name"))
    return asof_join(addresses, first, "address", bucket=bucket)


def containing_function(addresses: DataFrame, functions: DataFrame, bucket: Column | None = None) -> DataFrame:
    """addresses (address) as-of functions (addr_start, addr_end, ...): only the nearest start is looked at, null if it ends before."""
    right = functions.withColumn("address", F.col("addr_start"))
    found = asof_join(addresses, right, "address", bucket=bucket, tie="addr_end")
    return found.withColumn("match", F.when(F.col("address") < F.col("match.addr_end"), F.col("match")))


def range_first(points: DataFrame, ranges: DataFrame, point: str, by: list[str], order: str, width: int) -> DataFrame:
    """Points and the first range (start, end, both inclusive) by ``order`` that holds them."""
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    met = points.withColumn("_b", F.floor(F.col(point) / width)).join(spread, [*by, "_b"]).where(F.col(point).between(F.col("start"), F.col("end")))
    cols = [c for c in points.columns]
    return met.groupBy(*cols).agg(F.min_by(F.struct(*[c for c in ranges.columns if c not in by]), order).alias("match"))


def overlaps(a: DataFrame, b: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of intervals (start, end; inclusive) that share a point, once each: in the bucket where the later one starts."""
    def spread(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, F.struct(*[c for c in df.columns if c not in by]).alias(name), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))

    met = spread(a, "a").join(spread(b, "b"), [*by, "_b"])
    return met.where((F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end")) & (F.col("_b") == F.floor(F.greatest("a.start", "b.start") / width))).drop("_b")


def upper_median(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The element at count div 2 of the sorted values that aren't null; a key with a third of all rows is many tasks."""
    by = by or []
    placed = written(numbered(values.where(F.col(value).isNotNull()).select(*by, value), [*by, value], "_at"), "placed")
    middle = placed.groupBy(*by).agg((F.min("_at") + F.floor(F.count("*") / 2)).alias("_at"))
    return placed.join(middle.select("_at"), "_at").select(*by, F.col(value).alias("upper_median"))


def slide(live: DataFrame, static: DataFrame, anchors: list[str]) -> DataFrame:
    """The upper median, over anchor names, of live less static address (name, address); anchors are few."""
    own = static.where(F.col("name").isin(anchors)).groupBy("name").agg(F.min("address").alias("s"))
    met = live.where(F.col("name").isin(anchors) & (F.col("address") > 0)).groupBy("name").agg(F.min_by("address", "line_no").alias("l")).join(own, "name")
    return upper_median(met.select((F.col("l") - F.col("s")).alias("slide")), "slide")
