"""Analysis records: the fact table that the statistics read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import strip
from colophon.operators.fill import FILL_BLOCK, fill_down, non_blank


def cell(column: str) -> Column:
    """Cell text: outer white space dropped, NULL as empty text."""
    return F.coalesce(strip(F.col(column)), F.lit(""))


def running_count(df: DataFrame, sheet: str, row: str, flags: dict[str, Column]) -> DataFrame:
    """Running number of true flags by sheet and row: counts within blocks plus the counts of the blocks before."""
    marked = df.select("*", F.floor(F.col(row) / FILL_BLOCK).alias("_block"), *[F.when(c, 1).otherwise(0).alias(f"_n_{n}") for n, c in flags.items()])
    before = Window.partitionBy("_sheet").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(F.col(sheet).alias("_sheet"), F.col("_block").alias("_at")).agg(*[F.sum(f"_n_{n}").alias(f"_s_{n}") for n in flags])
    carried = sums.select("_sheet", "_at", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in flags])
    within = Window.partitionBy(sheet, "_block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.select("*", *[F.sum(f"_n_{n}").over(within).alias(f"_w_{n}") for n in flags])
    joined = counted.join(carried.where("_at > 0"), (F.col(sheet) == F.col("_sheet")) & (F.col("_block") == F.col("_at")), "left")
    return joined.select(*df.columns, *[(F.col(f"_w_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in flags])


def first_delivery(rows: DataFrame, key: str = "mention_id", at: str = "loaded_at") -> DataFrame:
    """One row per key: the earliest delivered."""
    order = Window.partitionBy(key).orderBy(F.col(at).asc_nulls_last())
    return rows.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def analysis_records(rows: DataFrame) -> DataFrame:
    """Records of the annotation sheet.

    Titles are filled down; the article id counts the non-blank title cells of a sheet, so a repeated
    title starts a new article; the strength id counts the rows that carry a strength. The group is G1
    for labels that begin so, else G2 (blanks too); the field follows the first hyphen of the label.
    Of the position only the case of 'discussion' is corrected; the raw value is kept.
    """
    base = first_delivery(rows).select(
        "mention_id", "workbook", "source_row", cell("lable").alias("label"), cell("journal").alias("journal"), "year",
        non_blank("self_citing_article").alias("title"), non_blank("self_cited_article").alias("cited"),
        cell("citation_content").alias("content"), cell("citation_position").alias("position_raw"), cell("citation_distance").alias("distance"),
        F.col("citation_strength").alias("strength_value"), cell("citation_function").alias("function"), cell("citation_depth").alias("depth"),
        F.col("semantic_similarity").alias("similarity"),
    )
    base = base.withColumn("title_anchor", strip(F.col("title"))).withColumn("cited_raw", strip(F.col("cited")))
    filled = fill_down(base, "workbook", "source_row", ["title", "cited"])
    counted = running_count(
        filled, "workbook", "source_row",
        {"article_no": F.col("title_anchor").isNotNull(), "anchor_no": F.col("strength_value").isNotNull()},
    )
    value = F.col("strength_value")
    return counted.select(
        "mention_id", "workbook", "source_row", "label", F.when(F.col("label").startswith("G1"), "G1").otherwise("G2").alias("grp"),
        F.when(F.col("label").contains("-"), F.expr("substring(label, instr(label, '-') + 1)")).otherwise("").alias("field"),
        "journal", "year", F.concat("workbook", F.lit("/A"), F.lpad(F.col("article_no").cast("string"), 4, "0")).alias("article_id"),
        strip(F.col("title")).alias("article_title"), F.coalesce("title_anchor", F.lit("")).alias("title_anchor"),
        F.coalesce("cited_raw", F.lit("")).alias("cited_raw"), strip(F.col("cited")).alias("cited"), "content",
        F.when(F.lower("position_raw") == "discussion", "Discussion").otherwise(F.col("position_raw")).alias("position"), "position_raw",
        "distance", value.isNotNull().alias("has_strength"), F.col("anchor_no"),
        F.when(value.isNotNull(), F.concat("workbook", F.lit("/S"), F.lpad(F.col("anchor_no").cast("string"), 4, "0"))).otherwise("").alias("strength_id"),
        value.alias("strength_value"), strength_bucket(value).alias("strength"), "function", "depth", "similarity",
    )


def strength_bucket(value: Column) -> Column:
    """'>=5' from five on, else the whole number as text; NULL without strength."""
    return F.when(value >= 5, ">=5").when(value.isNotNull(), value.cast("int").cast("string"))


def with_field_names(records: DataFrame, journals: DataFrame) -> DataFrame:
    """Adds ``field_name`` of the field number; NULL for an unknown field. One row per field is broadcast (a fixed list)."""
    names = journals.groupBy(F.col("field_no").cast("string").alias("field")).agg(F.min("field_name").alias("field_name"))
    return records.join(F.broadcast(names), "field", "left")


def first_rows(rows: DataFrame, n: int, sheet: str = "workbook", row: str = "source_row") -> DataFrame:
    """The first ``n`` data rows of each sheet by sheet row, blank ones counted too."""
    place = F.row_number().over(Window.partitionBy(sheet).orderBy(row))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
