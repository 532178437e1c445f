"""Session helpers shared by the operators: reading tables, cutting lineage, Arrow row passes."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``, which is read from the session.

    Where it is unset, a session of one machine (tests, a laptop) gets a temporary folder; on a cluster it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="colophon-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def arrow_pass(df: DataFrame, rows: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Narrow pass over Arrow batches: ``rows`` gets the dicts of a batch and yields tuples of ``schema``."""
    names = [field.name for field in df.sparkSession.createDataFrame([], schema).schema.fields]
    target = df.sparkSession.createDataFrame([], schema).schema

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            out = list(rows(batch.to_pylist()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)], names=names
                )

    return df.mapInArrow(run, target)
