"""Quality control of the records: anchor blocks, distinct pairs with filled values, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from colophon.functions.text import BLANK, strip


def anchor_blocks(records: DataFrame) -> DataFrame:
    """Flagged strength blocks: the rows from one strength cell to the next in a sheet.

    Flags: block length differs from the strength; more than one article; more than one cited text. Rows
    before the first anchor of a sheet belong to no block. Only flagged blocks come out.
    """
    rows = records.where("anchor_no > 0")
    blocks = rows.groupBy("workbook", "anchor_no").agg(
        F.max("strength_id").alias("strength_id"), F.min("source_row").alias("source_row"), F.max("strength_value").cast("int").alias("strength"),
        F.count(F.lit(1)).alias("block_rows"), F.countDistinct("article_id").alias("articles"),
        F.countDistinct(F.when(F.col("cited_raw") != "", F.col("cited_raw"))).alias("cited_texts"),
    )
    # Names of the flags
    flags = F.array_compact(
        F.array(
            F.when(F.col("block_rows") != F.col("strength"), "block_length_differs_from_strength"),
            F.when(F.col("articles") != 1, "block_crosses_article_boundary"),
            F.when(F.col("cited_texts") > 1, "multiple_self_cited_strings_within_block"),
        )
    )
    return blocks.withColumn("flags", F.array_join(flags, ",")).where("flags <> ''").drop("anchor_no")


def filled_pairs(records: DataFrame) -> DataFrame:
    """Distinct (label, filled title, filled cited text) per label; blank cells are filled inside their sheet."""
    keys = records.select("label", F.coalesce("article_title", F.lit("")).alias("t"), F.coalesce("cited", F.lit("")).alias("c")).distinct()
    return keys.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"))


def label_counters(records: DataFrame) -> DataFrame:
    """Mentions, articles and strength rows, in total, by group and by label, in one pass of grouping sets."""
    marked = records.select("grp", "label", "article_id", F.col("has_strength").cast("int").alias("s"))
    return (
        marked.groupingSets([[], [F.col("grp")], [F.col("grp"), F.col("label")]], "grp", "label")
        .agg(
            F.coalesce("grp", F.lit("all")).alias("g"), F.coalesce("label", F.lit("all")).alias("l"), F.grouping_id().alias("level"),
            F.count(F.lit(1)).alias("mentions"), F.countDistinct("article_id").alias("articles"), F.coalesce(F.sum("s"), F.lit(0)).alias("strength_rows"),
        )
        .select(F.when(F.col("level") == 3, "all").otherwise(F.col("g")).alias("grp"), F.when(F.col("level") > 0, "all").otherwise(F.col("l")).alias("label"), "mentions", "articles", "strength_rows")
    )


def value_histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of the raw values of a column; NULL is a value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def validity(rows: DataFrame, required: list[str], domains: dict[str, list[str]]) -> DataFrame:
    """Adds `reason`: why a row is rejected, or '' for a valid one; blank rows are 'blank'."""
    text = {c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) for c in [*required, *domains]}
    blank = F.lit(True)
    for c in text.values():
        blank = blank & (c == "")
    reason = F.when(blank, "blank")
    for c in required:
        reason = reason.when(text[c] == "", f"missing {c}")
    for c, allowed in domains.items():
        reason = reason.when(~text[c].isin(allowed), f"unknown {c}")
    return rows.withColumn("reason", reason.otherwise(""))


def pass_counters(rows: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Counters of a scoring pass in one aggregation: rows, skipped (a blank text on either side), scored, failed, words, unchanged.

    ``words`` sums the words of ``right`` over the rows that aren't skipped; ``unchanged`` counts rows whose texts are equal,
    as after a pass that fell back to its input.
    """
    filled = lambda c: F.coalesce(F.col(c).rlike(rf"[^{BLANK[1:]}"), F.lit(False))
    both = filled(left) & filled(right)
    words = F.size(F.regexp_extract_all(F.col(right), F.lit("([^ ]+)"), 1))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~both).alias("skipped"), F.count_if(both & F.col(score).isNotNull()).alias("scored"),
        F.count_if(both & F.col(score).isNull()).alias("failed"), F.coalesce(F.sum(F.when(both, words)), F.lit(0)).cast("long").alias("words"),
        F.count_if(both & (F.col(left) == F.col(right))).alias("unchanged"),
    )


def with_total(rows: DataFrame, code: str, name: str = "Total") -> DataFrame:
    """The rows and a total row: sums of the numbers, NULL in other columns."""
    numbers = {f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType)}
    cells = [F.sum(c).alias(c) if c in numbers else F.lit(name if c == code else None).cast("string").alias(c) for c in rows.columns]
    return rows.unionByName(rows.agg(*cells))


def without_total(rows: DataFrame, code: str, name: str = "Total") -> DataFrame:
    """Rows but the total row; rows without a code are kept."""
    return rows.where(~F.col(code).eqNullSafe(name))
