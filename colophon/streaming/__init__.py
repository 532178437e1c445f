"""The stateless operators on streams of new files, and rows that are delivered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions.text import context_flag
from colophon.operators.chat import line_faults


def chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the JSON lines of new files in a folder, with their turns and fault."""
    return line_faults(spark.readStream.text(folder))


def new_rows(stream: DataFrame, key: str = "mention_id", at: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """Each key of a stream once: a second delivery is dropped if it comes within ``delay`` of the first.

    The state holds the keys of that span only. Times without zone are taken as UTC.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def flagged(stream: DataFrame, text: str = "citation_content") -> DataFrame:
    """Adds the quality flag of each row's context."""
    return stream.withColumn("flag", context_flag(F.coalesce(F.col(text), F.lit(""))))


def flag_windows(stream: DataFrame, at: str = "loaded_at", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, flag, n): flags per window of time; a window closes when the watermark has passed it."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, width).alias("w"), "flag").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "flag", "n")
