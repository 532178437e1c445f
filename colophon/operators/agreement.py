"""Agreement of two label columns: kappa, confusion matrix, class metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import cell_text


def label_pairs(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(actual, predicted, complete): cell texts of two columns; rows with both blank are left out.

    ``complete`` is false where just one side is blank: such a pair is an error of the sheet.
    """
    both = rows.select(cell_text(F.col(truth)).alias("actual"), cell_text(F.col(predicted)).alias("predicted"))
    return both.where("actual <> '' or predicted <> ''").withColumn("complete", (F.col("actual") != "") & (F.col("predicted") != ""))


def pair_counts(rows: DataFrame, truth: str, predicted: str, strict: bool = True) -> DataFrame:
    """(actual, predicted, n) in one aggregation. A half-blank pair stops the query; without ``strict`` it is left out."""
    pairs = label_pairs(rows, truth, predicted)
    fault = F.raise_error(F.lit("a pair of labels is half blank")).cast("boolean") if strict else F.lit(False)
    kept = pairs.where(F.when(F.col("complete"), F.lit(True)).otherwise(fault))
    return kept.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(counts: DataFrame) -> DataFrame:
    """(n, observed, expected, kappa): NULL kappa where the expected agreement is complete."""
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("a"))
    right = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("b"))
    chance = left.join(right, "label").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    one = total.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    observed, expected = F.try_divide("same", "n"), F.try_divide(F.coalesce("ab", F.lit(0.0)), F.col("n").cast("double") * F.col("n"))
    return one.select(
        F.col("n").cast("long").alias("n"), observed.alias("observed"), expected.alias("expected"), F.try_divide(observed - expected, 1 - expected).alias("kappa")
    )


def confusion(counts: DataFrame) -> DataFrame:
    """(actual, predicted, n): square over all labels, zeros kept. Labels are few: the grid is built per label list."""
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    listed = labels.groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_set("label")).alias("all"))
    grid = listed.select(F.explode("all").alias("actual"), "all").select("actual", F.explode("all").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """(category, precision, recall, f1, support, predicted): zero where a ratio has no base."""
    square = confusion(counts)
    actual = square.groupBy(F.col("actual").alias("category")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit")
    )
    predicted = square.groupBy(F.col("predicted").alias("category")).agg(F.sum("n").alias("predicted"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = actual.join(predicted, "category").withColumn("precision", zero(F.col("hit"), F.col("predicted"))).withColumn(
        "recall", zero(F.col("hit"), F.col("support"))
    )
    f1 = zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("category", "precision", "recall", f1.alias("f1"), "support", "predicted", "hit")


def average_metrics(metrics: DataFrame) -> DataFrame:
    """(average, precision, recall, f1, n, accuracy): macro over labels and weighted by support."""
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = F.try_divide(F.sum("hit"), total)
    macro = metrics.agg(F.lit("macro").alias("average"), *[F.avg(c).alias(c) for c in names], total.alias("n"), accuracy.alias("accuracy"))
    weighted = metrics.agg(
        F.lit("weighted").alias("average"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names], total.alias("n"), accuracy.alias("accuracy")
    )
    return macro.unionAll(weighted)


def missing_labels(counts: DataFrame, taxonomy: list[str]) -> DataFrame:
    """(ord, category): labels of the taxonomy that neither side uses, in its order."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame(list(enumerate(taxonomy, 1)), "ord int, category string")
    seen = counts.select(F.explode(F.array("actual", "predicted")).alias("category")).distinct()
    return wanted.join(seen, "category", "left_anti").select("ord", "category")


def confusion_pivot(counts: DataFrame, labels: list[str]) -> DataFrame:
    """One row per actual label, one column per predicted label."""
    return confusion(counts).groupBy("actual").pivot("predicted", labels).agg(F.sum("n")).select(
        "actual", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels]
    )


def label_union(counts: DataFrame) -> DataFrame:
    """All labels of either side with their counts on both."""
    a = counts.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("as_actual"))
    b = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("as_predicted"))
    return a.join(b, "label", "full").select("label", F.coalesce("as_actual", F.lit(0)).alias("as_actual"), F.coalesce("as_predicted", F.lit(0)).alias("as_predicted"))


def ranked_confusions(counts: DataFrame) -> DataFrame:
    """Wrong predictions by how often they happen: rank 1 is the most frequent (equal counts share a rank)."""
    wrong = counts.where("actual <> predicted")
    return wrong.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n"))))
