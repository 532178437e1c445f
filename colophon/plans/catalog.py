"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colophon.operators import schema_drift
from colophon.plans import citing, labels, statistics, texts
from colophon.plans.runtime import table

MODULES = (statistics, texts, citing, labels)
Query = Callable[[SparkSession, str], DataFrame]

# Columns of the annotation sheet, in sheet order.
SHEET_COLUMNS = [
    "lable", "journal", "year", "self-citing article", "self-cited article", "citation content", "citation position",
    "citation distance", "citation strength", "citation function", "citation depth", "semantic similarity",
]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = schema_drift.schema_changes(table(spark, sf, "workbook_dumps"))
    return changes.selectExpr("file as file_id", "change_kind", "header_before", "header_after")


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, sf, "workbook_dumps"), SHEET_COLUMNS)


def queries() -> dict[str, Query]:
    own = {f.__name__: f for module in MODULES for f in module.QUERIES}
    return own | {"p2_found": p2_found, "p2_table": p2_table}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
