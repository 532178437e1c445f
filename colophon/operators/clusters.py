"""Cluster tables and resampling: bootstrap intervals and Monte-Carlo p-values.

Resampling works on cluster sums, never on rows. Draws are md5 numbers of (test, group, iteration,
place), the same in every engine; each cluster row brings the draws of its own place, so the draws are
made where the clusters are and no array grows with their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.order import hashed_position
from colophon.plans.runtime import arrow_pass

# Seed to which the checksum of a test's label is added, and tables per request to the
# generator; both decide the numbers that a published p-value comes from.
BASE_SEED = 20260726
CHUNK = 10_000
#: Bounds of the percentile interval.
LOWER, UPPER = 0.025, 0.975


def seed_of(label: str, base: int = BASE_SEED) -> int:
    return base + zlib.crc32(label.encode("utf-8"))


def cluster_counts(records: DataFrame, cluster: str, category: str, keys: list[str] | None = None) -> DataFrame:
    """(*keys, grp, cluster, category, n): sparse cluster matrix; NULL categories are left out."""
    return records.where(F.col(category).isNotNull()).groupBy(
        *(keys or []), "grp", F.col(cluster).alias("cluster"), F.col(category).alias("category")
    ).agg(F.count(F.lit(1)).alias("n"))


def cluster_sums(records: DataFrame, cluster: str, value: str) -> DataFrame:
    """(grp, cluster, total, n) of the non-NULL values."""
    return records.where(F.col(value).isNotNull()).groupBy("grp", F.col(cluster).alias("cluster")).agg(
        F.sum(F.col(value).cast("double")).alias("total"), F.count(F.lit(1)).alias("n")
    )


def _draw(*parts: Column) -> Column:
    """Pseudorandom non-negative number of md5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("long")


def drawn_clusters(clusters: DataFrame, keys: list[str], iterations: int, paired: bool) -> DataFrame:
    """(*keys, grp, it, pos, size, w): how often the cluster at a place is drawn in each iteration; only drawn ones.

    ``clusters`` has grp, pos and size. With ``paired`` both groups draw the same places.
    """
    places = clusters.select(*keys, "grp", F.col("pos").alias("slot"), "size", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it"))
    parts = [F.col(k) for k in keys] + ([F.lit("p")] if paired else [F.col("grp")]) + [F.col("it"), F.col("slot")]
    drawn = places.select(*keys, "grp", "it", "size", F.pmod(_draw(*parts), F.col("size")).alias("pos"))
    return drawn.groupBy(*keys, "grp", "it", "pos", "size").agg(F.count(F.lit(1)).alias("w"))


def _interval(per: DataFrame, keys: list[str]) -> DataFrame:
    ci = F.percentile("d", F.array(F.lit(LOWER), F.lit(UPPER)))
    return per.groupBy(*keys).agg(F.get(ci, F.lit(0)).alias("lower"), F.get(ci, F.lit(1)).alias("upper"), F.count(F.lit(1)).alias("iterations"))


def bootstrap_means(sums: DataFrame, iterations: int, paired: bool = False) -> DataFrame:
    """(lower, upper, iterations): interval of mean(G1) - mean(G2) over resampled clusters.

    Each group draws its own clusters and pools their sums; ``paired`` draws the same places for both groups
    (their clusters must have the same names) and averages the clusters' means without weights.
    """
    numbered = hashed_position(sums, ["grp"], "cluster", "pos", "size")
    drawn = drawn_clusters(numbered, [], iterations, paired)
    joined = drawn.join(numbered.select("grp", "pos", "total", "n"), ["grp", "pos"])
    mean = F.sum(F.col("w") * F.col("total") / F.col("n")) / F.sum("w") if paired else F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("n"))
    per = joined.groupBy("it").pivot("grp", ["G1", "G2"]).agg(mean)
    return _interval(per.select((F.col("G1") - F.col("G2")).alias("d")), [])


def bootstrap_shares(counts: DataFrame, iterations: int, keys: list[str] | None = None, paired: bool = False) -> DataFrame:
    """(*keys, category, lower, upper, iterations): intervals of the difference of category shares of G1 and G2.

    ``counts`` is the sparse cluster matrix. Shares are pooled over the drawn clusters; with ``paired`` they are
    averaged over them without weights, both groups drawing the same places. A category that no drawn
    cluster has counts as a share of 0.
    """
    keys = keys or []
    clusters = counts.groupBy(*keys, "grp", "cluster").agg(F.sum("n").alias("whole"))
    numbered = hashed_position(clusters, [*keys, "grp"], "cluster", "pos", "size")
    weights = drawn_clusters(numbered, keys, iterations, paired).join(numbered.select(*keys, "grp", "pos", "cluster", "whole"), [*keys, "grp", "pos"])
    base = F.max("size").cast("double") if paired else F.sum(F.col("w") * F.col("whole")).cast("double")
    bases = weights.groupBy(*keys, "grp", "it").agg(base.alias("base"))
    part = F.col("w") * F.col("n") / F.col("whole") if paired else (F.col("w") * F.col("n")).cast("double")
    hits = weights.join(counts, [*keys, "grp", "cluster"]).groupBy(*keys, "category", "grp", "it").agg(F.sum(part).alias("hit"))
    shares = hits.join(bases, [*keys, "grp", "it"]).select(
        *keys, "category", "it", (F.when(F.col("grp") == "G1", F.col("hit")).otherwise(-F.col("hit")) / F.col("base")).alias("s")
    )
    frame = counts.select(*keys, "category").distinct().withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    both = shares.groupBy(*keys, "category", "it").agg(F.sum("s").alias("d"))
    per = frame.join(both, [*keys, "category", "it"], "left").select(*keys, "category", F.coalesce("d", F.lit(0.0)).alias("d"))
    return _interval(per, [*keys, "category"])


def observed_differences(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, category, difference): share of G1 less share of G2 over all clusters."""
    keys = keys or []
    per = counts.groupBy(*keys, "category").agg(
        F.sum(F.when(F.col("grp") == "G1", F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("grp") != "G1", F.col("n")).otherwise(0)).alias("n2")
    )
    whole = Window.partitionBy(*keys)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(0.0))
    return per.select(*keys, "category", (share("n1") - share("n2")).alias("difference"))


def with_intervals(counts: DataFrame, iterations: int, keys: list[str] | None = None, paired: bool = False) -> DataFrame:
    """(*keys, category, difference, lower, upper, excludes_zero): observed differences with their interval."""
    keys = keys or []
    joined = observed_differences(counts, keys).join(bootstrap_shares(counts, iterations, keys, paired), [*keys, "category"])
    return joined.select(*keys, "category", "difference", "lower", "upper", ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("excludes_zero"))


def permutation_p(records: DataFrame, category: str, iterations: int, key: str = "mention_id") -> DataFrame:
    """(observed, extreme, iterations, p): chi-square under label permutations in md5 order, margins fixed.

    Each iteration gives the first n1 rows in the order of a hash of (iteration, key) to group one: the
    fixed-margin null, which every engine draws alike. Rows are multiplied by the iterations, so this is the
    check of ``monte_carlo`` on slices. A table without a second group or category has NULL results.
    """
    rows = records.where(F.col(category).isNotNull()).select(F.col(key).alias("k"), F.col(category).alias("c"), F.col("grp"))
    n1 = F.count_if(F.col("grp") == "G1")
    sizes = rows.agg(n1.alias("n1"), F.count(F.lit(1)).alias("nn")).withColumn("j", F.lit(1))
    margins = rows.groupBy("c").agg(F.count(F.lit(1)).alias("ct"), n1.alias("o")).withColumn("j", F.lit(1))
    expected = margins.join(F.broadcast(sizes), "j").withColumn("e", F.col("n1") * F.col("ct") / F.col("nn"))
    term = lambda a: F.try_divide(F.pow(a - F.col("e"), 2), F.col("e")) + F.try_divide(F.pow(a - F.col("e"), 2), F.col("ct") - F.col("e"))
    observed = expected.agg(F.sum(term(F.col("o"))).alias("observed")).withColumn("j", F.lit(1))
    repeated = rows.select("k", "c", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("it"))
    order = Window.partitionBy("it").orderBy(F.md5(F.concat_ws("-", "it", "k")), "k")
    first = repeated.withColumn("r", F.row_number().over(order)).withColumn("j", F.lit(1)).join(F.broadcast(sizes), "j")
    taken = first.groupBy("it", "c").agg(F.count_if(F.col("r") <= F.col("n1")).alias("a"))
    simulated = taken.join(F.broadcast(expected.select("c", "ct", "e")), "c").groupBy("it").agg(F.sum(term(F.col("a"))).alias("x"))
    tagged = simulated.withColumn("j", F.lit(1)).join(F.broadcast(observed), "j")
    return tagged.agg(
        F.max("observed").alias("observed"), F.count_if(F.col("x") >= F.col("observed") - 1e-12).alias("extreme"), F.count(F.lit(1)).alias("iterations")
    ).withColumn("p", F.when(F.col("observed").isNotNull(), (F.col("extreme") + 1) / (F.col("iterations") + 1)))


def extreme_tables(n1: list[int], n2: list[int], iterations: int, seed: int) -> int:
    """How many of ``iterations`` random tables with the margins of (n1, n2) lie at least as far from independence.

    Both cells of a column deviate alike, so one row tells the statistic: the squared deviation times
    N^2 / (N1 N2 C) per column.
    """
    row = np.array(n1, np.int64)
    columns = row + np.array(n2, np.int64)
    row, columns = row[columns > 0], columns[columns > 0]
    size, total = int(row.sum()), int(columns.sum())
    centre = size * columns / total
    scale = total * total / (size * (total - size)) / columns
    distance = lambda draws: ((draws - centre) ** 2) @ scale
    bound = distance(row) - 1e-12
    generator = np.random.default_rng(seed)
    requests = [CHUNK] * (iterations // CHUNK) + [iterations % CHUNK] * (iterations % CHUNK > 0)
    return sum(int(np.count_nonzero(distance(generator.multivariate_hypergeometric(columns, size, many)) >= bound)) for many in requests)


def monte_carlo(tables: DataFrame, iterations: int, base: int = BASE_SEED) -> DataFrame:
    """(test, extreme, iterations, p): one task per table; ``tables`` has test, n1 and n2 (arrays in category order).

    A table without a second group has no p.
    """

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            n1, n2 = r["n1"], r["n2"]
            if not sum(n1) or not sum(n2):
                yield r["test"], None, iterations, None
                continue
            extreme = extreme_tables(n1, n2, iterations, seed_of(r["test"], base))
            yield r["test"], extreme, iterations, (extreme + 1) / (iterations + 1)

    return arrow_pass(tables.select("test", "n1", "n2"), rows, "test string, extreme long, iterations long, p double")


def count_arrays(table: DataFrame, keys: list[str]) -> DataFrame:
    """Dense long table to (*keys, n1, n2): counts of both groups in category order."""
    listed = lambda g: F.transform(F.array_sort(F.collect_list(F.when(F.col("grp") == g, F.struct("ord", "n")))), lambda s: s["n"])
    return table.groupBy(*keys).agg(listed("G1").alias("n1"), listed("G2").alias("n2"))
