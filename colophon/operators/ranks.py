"""Rank test of two groups, tie-corrected; distribution over value groups, not over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions.order import sum_before
from colophon.functions.special import erfc
from colophon.plans.runtime import cut_lineage


def mann_whitney(values: DataFrame, group: str, value: str, keys: list[str] | None = None, first: str = "G1") -> DataFrame:
    """Mann-Whitney U of group ``first`` against the rest, per key.

    Equal values are aggregated before anything is ordered; the cumulative counts run over distinct
    values, in ranges, so that no task orders them all. NULL values are left out. The sign of z follows U below its mean; where |U - mean| is under
    the continuity correction the sign turns, as in the reference results.
    """
    keys = keys or []
    v = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), (F.col(group) == first).alias("one"))
    ties = v.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("t"), F.count_if("one").alias("t1"))
    ranked = sum_before(cut_lineage(ties), keys, "v", "t", "smaller").withColumn("rank", F.col("smaller") + (F.col("t") + 1) / 2.0)
    t, t1 = F.col("t").cast("double"), F.col("t1").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("rank") * t1).alias("r1"), F.sum(t1).alias("n1"), F.sum(t - t1).alias("n2"), F.sum(t * t * t - t).alias("ties"),
        F.sum(F.col("v") * t1).alias("s1"), F.sum(F.col("v") * (t - t1)).alias("s2"),
        F.sum(F.col("v") * F.col("v") * t1).alias("q1"), F.sum(F.col("v") * F.col("v") * (t - t1)).alias("q2"),
    )
    u, product, n = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2")
    with_u = sums.withColumn("u1", u).withColumn("product", product).withColumn(
        "variance", product / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    )
    mean = F.col("product") / 2
    raw = F.try_divide(F.abs(F.col("u1") - mean) - F.when(F.col("u1") != mean, 0.5).otherwise(0.0), F.sqrt("variance"))
    sd = lambda q, s, m: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col(m)), F.col(m) - 1)))
    return with_u.withColumn("raw", raw).select(
        *keys, "u1", (F.col("product") - F.col("u1")).alias("u2"), F.when(F.col("u1") < mean, -F.col("raw")).otherwise(F.col("raw")).alias("z"),
        F.when(F.col("raw").isNotNull(), erfc(F.abs("raw") / F.sqrt(F.lit(2.0)))).alias("p"), F.col("n1").cast("long").alias("n1"),
        F.col("n2").cast("long").alias("n2"), F.try_divide("s1", "n1").alias("mean1"), sd("q1", "s1", "n1").alias("sd1"),
        F.try_divide("s2", "n2").alias("mean2"), sd("q2", "s2", "n2").alias("sd2"),
        (1 - F.try_divide(2 * F.col("u1"), F.col("product"))).alias("rank_biserial"),
    )


def report(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Report form: six digits, p as its decimal logarithm."""
    return tests.select(
        *keys, F.round("u1", 6).alias("u1"), F.round("z", 6).alias("z"), F.when(F.col("p") > 0, F.round(F.log10("p"), 4)).alias("log10_p"),
        F.round("rank_biserial", 6).alias("rank_biserial"), "n1", "n2",
    )
