"""False-discovery-rate adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(tests: DataFrame, name: str, p: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(*keys, name, p, adjusted, significant): p * m / rank, made monotone from the largest p down, at most 1.

    Tests without p take no part. Equal p are ordered by name. One family per key. ``order`` names a column for the rank.
    """
    keys = keys or []
    family = Window.partitionBy(*keys)
    ranked = tests.where(F.col(p).isNotNull()).select(*keys, F.col(name).alias("name"), F.col(p).alias("p")).select(
        "*", F.row_number().over(family.orderBy("p", "name")).alias("rank"), F.count(F.lit(1)).over(family).alias("m")
    )
    down = family.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rank")).over(down))
    return ranked.select(*keys, "name", "p", adjusted.alias("adjusted"), *([F.col("rank").alias(order)] if order else [])).withColumn("significant", F.col("adjusted") < 0.05)
