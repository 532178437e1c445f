"""Contingency tables of two groups: dense counts, chi-square tests, leave-one-out, binary collapse.

One aggregation over the records gives counts per (dimension, category, group, field, label); every
test works on that table, whose size is bounded by the vocabularies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.special import chi2_tail
from colophon.functions.vocab import DIMENSIONS, DISPLAY, LABELS, categories
from colophon.plans.runtime import cut_lineage


def label_counts(records: DataFrame) -> DataFrame:
    """(dim, category, grp, field, label, n): one pass over the records; blank categories are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(dim).alias("dim"), F.col(dim).alias("category")) for dim, _ in DIMENSIONS]))
    long = records.select("grp", "field", "label", cells.alias("c")).where(F.col("c.category").isNotNull())
    return long.groupBy("c.dim", "c.category", "grp", "field", "label").agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, dim, ord, category, grp, n): every category for both groups, zeros kept, other values dropped.

    The vocabulary is broadcast: it has a fixed number of rows.
    """
    keys = keys or []
    vocabulary = F.broadcast(categories(counts.sparkSession))
    known = counts.join(vocabulary, ["dim", "category"])
    sums = known.groupBy(*keys, "dim", "ord", "category").agg(
        F.coalesce(F.sum(F.when(F.col("grp") == "G1", F.col("n"))), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(F.col("grp") == "G2", F.col("n"))), F.lit(0)).alias("n2"),
    )
    frame = counts.select(*keys, "dim").distinct().join(vocabulary, "dim")
    full = frame.join(sums, [*keys, "dim", "ord", "category"], "left").select(
        *keys, "dim", "ord", "category", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2")
    )
    pair = F.explode(F.array(F.struct(F.lit("G1").alias("grp"), F.col("n1").alias("n")), F.struct(F.lit("G2").alias("grp"), F.col("n2").alias("n"))))
    return full.select(*keys, "dim", "ord", "category", pair.alias("c")).select(*keys, "dim", "ord", "category", "c.grp", "c.n")


def percentages(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds the share of the group within its dimension; NULL for an empty group."""
    whole = Window.partitionBy(*(keys or []), "dim", "grp")
    return table.withColumn("share", F.round(F.try_divide("n", F.sum("n").over(whole)), 6))


def chi_square(table: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson chi-square of the 2 x K table of each key: statistic, df, p, V, n, expected-cell diagnostics.

    Columns without any count are dropped. A table without a second group or category has NULL results.
    """
    column, row, all_ = Window.partitionBy(*keys, "category"), Window.partitionBy(*keys, "grp"), Window.partitionBy(*keys)
    cells = (
        table.withColumn("ct", F.sum("n").over(column)).where("ct > 0")
        .withColumn("rt", F.sum("n").over(row)).withColumn("nn", F.sum("n").over(all_))
        .withColumn("e", F.col("rt") * F.col("ct") / F.col("nn"))
    )
    out = cells.groupBy(*keys).agg(
        F.sum(F.try_divide(F.pow(F.col("n") - F.col("e"), 2), F.col("e"))).alias("chi2"), (F.countDistinct("category") - 1).alias("df"),
        F.max("nn").alias("n"), F.count_if(F.col("e") < 5).alias("expected_lt5"), F.count(F.lit(1)).alias("cells"), F.min("e").alias("min_expected"),
        F.min("rt").alias("least_row"),
    )
    usable = (F.col("least_row") > 0) & (F.col("df") > 0)
    return out.select(
        *keys, F.when(usable, F.col("chi2")).alias("chi2"), "df", F.when(usable, chi2_tail(F.col("chi2"), F.col("df"))).alias("p"),
        F.when(usable, F.sqrt(F.col("chi2") / F.col("n"))).alias("cramers_v"), "n", "expected_lt5", "cells", "min_expected",
    )


def rounded(tests: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Report form: doubles to six digits, p as its decimal logarithm."""
    p = F.when(F.col("p") > 0, F.round(F.log10("p"), 4))
    return tests.select(
        *keys, F.round("chi2", 6).alias("chi2"), F.col("df").cast("long").alias("df"), p.alias("log10_p"), F.round("cramers_v", 6).alias("cramers_v"),
        F.col("n").cast("long").alias("n"), *(extra or []),
    )


def leave_one_out(counts: DataFrame) -> DataFrame:
    """Chi-square of every dimension without one label, from the label counts; `excluded` names the label.

    The ten labels are exploded onto the counts (bounded by the vocabularies), not onto the records.
    """
    labels = F.explode(F.array(*map(F.lit, LABELS)))
    retained = counts.withColumn("excluded", labels).where(F.col("label") != F.col("excluded"))
    return chi_square(dense(retained, ["excluded"]), ["excluded", "dim"])


def binary_strength(counts: DataFrame) -> DataFrame:
    """Chi-square of strength collapsed to one and more than one."""
    table = dense(counts.where("dim = 'strength'"))
    collapsed = table.withColumn("category", F.when(F.col("category") == "1", "1").otherwise(">1")).groupBy("dim", "category", "grp").agg(F.sum("n").alias("n"))
    return chi_square(collapsed, ["dim"])


def counts_for_tests(records: DataFrame) -> DataFrame:
    return cut_lineage(label_counts(records))


def significance(p: Column) -> Column:
    """Yes or No at five percent, from the asymptotic p."""
    return F.when(p < 0.05, "Yes").otherwise("No")


def tally(tests: DataFrame, key: str, dim: str, dims: list[str]) -> DataFrame:
    """Per key: Yes or No for each dimension and the number of Yes as 'k/6'; a test without p is a No."""
    yes = F.coalesce(F.col("p") < 0.05, F.lit(False))
    cells = [F.coalesce(F.max(F.when(F.col(dim) == d, significance(F.col("p")))), F.lit("No")).alias(d) for d in dims]
    return tests.groupBy(key).agg(*cells, F.concat(F.count_if(yes).cast("string"), F.lit(f"/{len(dims)}")).alias("total"))


def display_name(category: Column) -> Column:
    """Name of a category in reports: a few are spelled otherwise, the rest stay."""
    names = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    return F.coalesce(F.try_element_at(names, category), category)


def report(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, dim, ord, category, n1, n2, share1, share2): both groups side by side under display names."""
    keys = keys or []
    side = table.groupBy(*keys, "dim", "ord", "category").pivot("grp", ["G1", "G2"]).agg(F.max("n"))
    whole = Window.partitionBy(*keys, "dim")
    share = lambda c: F.round(F.try_divide(F.col(c), F.sum(c).over(whole)), 6)
    return side.select(
        *keys, "dim", "ord", display_name(F.col("category")).alias("category"), F.col("G1").cast("long").alias("n1"), F.col("G2").cast("long").alias("n2"),
        share("G1").alias("share1"), share("G2").alias("share2"),
    )
