"""JSON, JSON lines and CSV: readers, and writers that never overwrite unasked.

Writers leave a folder of part files, which a failed job never shows as complete; ``single`` makes one
part, for results whose size is bounded (reports).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colophon.sources.sheets import workbook_bytes

BOM = "﻿"


def read_records(spark: SparkSession, path: str, name: str = "records", schema: StructType | str | None = None) -> DataFrame:
    """Rows of the array ``name`` of a JSON document."""
    reader = spark.read.option("multiLine", True)
    document = (reader.schema(schema) if schema else reader).json(path)
    return document.select(F.explode(name).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): lines of JSON line files as they are, blank ones too, for validation."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), "value")


def validated_lines(lines: DataFrame) -> DataFrame:
    """The valid records of JSON lines; an error names the first fault it meets. An empty input is an error, too."""
    from colophon.operators.chat import line_faults

    checked = line_faults(lines)
    fault = checked.where("fault <> ''").select("fault").head()
    if fault is not None:
        raise ValueError(f"invalid line: {fault[0]}")
    if checked.isEmpty():
        raise ValueError("no records")
    return checked.select("messages")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header and quoted cells; a byte order mark before the first header is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.toDF(*[c.removeprefix(BOM) for c in rows.columns])


def read_prompt(spark: SparkSession, path: str) -> str:
    """Text of a prompt file, outer white space dropped; a blank one is an error."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).removeprefix(BOM).strip()
    if not text:
        raise ValueError(f"prompt file is empty: {path}")
    return text


def guarded(df: DataFrame, path: str, source: str | None = None, ending: str | None = None) -> None:
    """Checks before a write: output apart from input, right ending."""
    if source is not None and os.path.normpath(source) == os.path.normpath(path):
        raise ValueError("input and output must be different")
    if ending and not path.casefold().endswith(ending):
        raise ValueError(f"output must end with {ending}: {path}")


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_lines(df: DataFrame, path: str, overwrite: bool = False, source: str | None = None) -> None:
    """JSON lines, letters of all scripts as they are, NULL fields left out."""
    guarded(df, path, source, ".jsonl")
    df.select(F.to_json(F.struct("*"))).write.mode(_mode(overwrite)).text(path)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A JSON document {"records": [...]} a part. For one document the rows must be few: see ``single``."""
    df.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("records")), {"pretty": "true"}).alias("value")).write.mode(_mode(overwrite)).text(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False, single: bool = True, mark: bool = True) -> None:
    """CSV with header in UTF-8; ``mark`` puts a byte order mark before it, for spreadsheet programs; ``single`` makes one part."""
    first, *rest = df.columns
    rows = df.withColumnRenamed(first, BOM + first) if mark else df
    (rows.coalesce(1) if single else rows).write.mode(_mode(overwrite)).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_workbook(df: DataFrame, path: str, overwrite: bool = False, source: str | None = None, sheet: str = "Sheet1") -> None:
    """One .xlsx file of a report. Sheets end at 1,048,576 rows, so the rows that reach the driver are bounded; more are an error."""
    guarded(df, path, source, ".xlsx")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    most = 1_048_575
    rows = [list(r) for r in df.limit(most + 1).toLocalIterator()]
    if len(rows) > most:
        raise ValueError(f"a sheet holds {most} rows at most")
    with open(path + ".tmp", "wb") as file:
        file.write(workbook_bytes(df.columns, iter(rows), sheet))
    os.replace(path + ".tmp", path)


def structural_columns(rows: DataFrame) -> DataFrame:
    """Columns of the structural sheet: all but the index of the cited article and the reference order."""
    return rows.drop("Self-cited Article Index", "ref_order", "doc_number", "position")


def insert_after(df: DataFrame, after: str, name: str, value: Column) -> DataFrame:
    """The table with a column right behind another; a column of that name is replaced."""
    columns = [c for c in df.columns if c != name]
    out = df.withColumn("_new", value)
    at = columns.index(after) + 1
    return out.select(*[F.col(f"`{c}`") for c in columns[:at]], F.col("_new").alias(name), *[F.col(f"`{c}`") for c in columns[at:]])


def with_flags(df: DataFrame, text: str) -> DataFrame:
    """Adds the cleaned text and the quality flags is_short, excess_dashes and multi_years; each is set only if none before it is."""
    from colophon.functions.text import clean_context, context_flag

    flag = context_flag(F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({
        f"{text}_cleaned": clean_context(F.coalesce(F.col(text), F.lit(""))), "is_short": flag == "short", "excess_dashes": flag == "dashes", "multi_years": flag == "years",
    })


def rejected_log(rows: DataFrame, reason: str, path: str, at: Column | None = None) -> None:
    """Appends the rejected rows with the time and their reason."""
    rows.where(F.col(reason) != "").withColumn("logged_at", F.current_timestamp() if at is None else at).write.mode("append").json(path)
