"""Positions and running sums over a whole table without one task that orders everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which a table is cut; sums of so many ranges a key are accumulated first.
RANGES = 256


def hashed_position(df: DataFrame, keys: list[str], name: str, to: str, size: str | None = None) -> DataFrame:
    """Adds ``to``: place of a row, from 0, among the rows of its keys in the order of (md5 of name, name).

    Ranges are the first digits of the md5 hash. ``size`` adds the number of rows of the keys.
    """
    tagged = df.withColumn("_h", F.md5(F.col(name).cast("string"))).withColumn("_r", F.substring("_h", 1, 2))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ranges = tagged.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select(*keys, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    inside = Window.partitionBy(*keys, "_r").orderBy("_h", name)
    placed = tagged.withColumn("_at", F.row_number().over(inside)).join(ranges, [*keys, "_r"])
    extra = [F.col("_size").alias(size)] if size else []
    return placed.select(*df.columns, (F.col("_before") + F.col("_at") - 1).alias(to), *extra)


def sum_before(df: DataFrame, keys: list[str], value: str, weight: str, to: str) -> DataFrame:
    """Adds ``to``: sum of ``weight`` over the rows of the same keys with a smaller ``value`` (values are distinct per key).

    The bounds of the ranges are approximate percentiles (one pass, RANGES numbers); the sums are exact whatever they are.
    """
    found = df.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("p")).head()[0]
    bounds = sorted(set(found or ()))
    place: Column = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(value))) if bounds else F.lit(0)
    tagged = df.withColumn("_r", place)
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = tagged.groupBy(*keys, "_r").agg(F.sum(weight).alias("_n")).select(*keys, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = tagged.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(ranges, [*keys, "_r"])
    return summed.select(*df.columns, (F.col("_before") + F.col("_own")).alias(to))
