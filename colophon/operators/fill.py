"""Forward fill of blank sheet cells, for sheets of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import BLANK

#: Sheet rows that are filled by one task.
FILL_BLOCK = 20_000


def non_blank(column: str | Column) -> Column:
    """The value, or NULL where it is empty or white space only."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.rlike(rf"[^{BLANK[1:]}"), value)


def fill_down(df: DataFrame, sheet: str, row: str, fields: list[str]) -> DataFrame:
    """Blank cells of ``fields`` get the last non-blank cell above, by sheet and row number.

    Blocks of FILL_BLOCK rows are filled on their own; the last value of the blocks before a block
    comes from a second window over one row per block, so a huge sheet doesn't end in one task.
    Cells with nothing above stay NULL. Other columns are kept; repeated rows stay repeated.
    """
    marked = df.select(
        *df.columns, *[non_blank(f).alias(f"_v_{f}") for f in fields], F.floor(F.col(row) / FILL_BLOCK).alias("_block")
    )
    blocks = marked.groupBy(F.col(sheet).alias("_sheet"), F.col("_block").alias("_at")).agg(
        *[F.max_by(f"_v_{f}", F.when(F.col(f"_v_{f}").isNotNull(), F.col(row))).alias(f"_b_{f}") for f in fields]
    )
    before = Window.partitionBy("_sheet").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_sheet", "_at", *[F.last(f"_b_{f}", True).over(before).alias(f"_c_{f}") for f in fields]).where(F.col("_at") > 0)
    within = Window.partitionBy(sheet, "_block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.select("*", *[F.last(f"_v_{f}", True).over(within).alias(f"_f_{f}") for f in fields])
    joined = filled.join(carried, (F.col(sheet) == F.col("_sheet")) & (F.col("_block") == F.col("_at")), "left")
    return joined.select(*[c for c in df.columns if c not in fields], *[F.coalesce(f"_f_{f}", f"_c_{f}").alias(f) for f in fields])
