"""Vectors: whitening, cosine and sign similarity, mean vectors."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL for a NULL or zero vector or unequal lengths."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def sign_similarity(a: Column, b: Column) -> Column:
    """Agreements less disagreements of the signs, over the number of components: the similarity that a normalisation
    along a single-element axis leaves. Components of zero count as neither."""
    sign = lambda v: F.transform(v, lambda x: F.signum(x))
    return cosine(sign(a), sign(b))


def neighbour_pairs(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key_a, key_b, a, b): each vector with the next one of its label by key.

    Keys are cut into ranges; the last vector of a range meets the first of the next in a second, small join, so a label
    that holds a third of all rows is never ordered by one task.
    """
    from pyspark.sql import Window

    rows = vectors.select(F.col(key).alias("k"), F.col(label).alias("l"), doubles(F.col(vector)).alias("v")).withColumn("r", F.floor(F.col("k") / 4096))
    inside = Window.partitionBy("l", "r").orderBy("k")
    pairs = rows.withColumn("kb", F.lead("k").over(inside)).withColumn("vb", F.lead("v").over(inside))
    # only the first of each range takes part in the window over ranges
    firsts = rows.groupBy("l", "r").agg(F.min_by(F.struct("k", "v"), "k").alias("first"))
    following = firsts.select("l", "r", F.lead("first").over(Window.partitionBy("l").orderBy("r")).alias("next"))
    joined = pairs.join(following, [pairs.l.eqNullSafe(following.l), pairs.r == following.r]).select(
        "k", F.coalesce("kb", "next.k").alias("kb"), "v", F.coalesce("vb", "next.v").alias("vb")
    )
    return joined.where("kb is not null").select(F.col("k").alias("key_a"), F.col("kb").alias("key_b"), F.col("v").alias("a"), F.col("vb").alias("b"))


def mean_vectors(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, n, at, mean): mean of each component, in one aggregation with partial sums. NULL vectors are left out."""
    parts = vectors.where(F.col(vector).isNotNull()).select(label, F.posexplode(doubles(F.col(vector))).alias("at", "x"))
    return parts.groupBy(label, "at").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def mean_of_chunks(chunks: Column) -> Column:
    """Unweighted mean of the vectors of an array; an error where it is empty, NULL for NULL."""
    many = F.size(chunks)
    total = F.aggregate(
        F.slice(chunks, 2, F.greatest(many - 1, F.lit(0))), doubles(F.get(chunks, F.lit(0))), lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y)
    )
    mean = F.transform(total, lambda x: x / many)
    return F.when(chunks.isNull(), None).when(many == 0, F.raise_error(F.lit("no chunk has a vector"))).otherwise(mean)


class Whitening:
    """Parameters of a whitening: kernel (d x k) and bias (d); read from JSON, never from pickled objects."""

    def __init__(self, kernel, bias):
        self.kernel, self.bias = np.asarray(kernel, np.float64), np.asarray(bias, np.float64)
        if self.kernel.ndim != 2 or self.bias.shape[-1] != self.kernel.shape[0]:
            raise ValueError(f"whitening shapes don't fit: kernel {self.kernel.shape}, bias {self.bias.shape}")
        self.bias = self.bias.reshape(-1)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Whitening:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        found = json.loads(text)
        if "kernel" not in found or "bias" not in found:
            raise ValueError("whitening parameters need 'kernel' and 'bias'")
        return cls(found["kernel"], found["bias"])


def whitened(vectors: DataFrame, vector: str, to: str, parameters: Whitening, normalise: bool = True) -> DataFrame:
    """Adds ``to``: (v + bias) @ kernel, of unit length; a matrix product per Arrow batch. NULL stays NULL."""
    kernel, bias = parameters.kernel, parameters.bias
    eps = float(np.finfo(np.float32).eps)
    source = vectors.withColumn(to, doubles(F.col(vector)))
    at = source.columns.index(to)

    def run(batches):
        for batch in batches:
            values = batch.column(at)
            known = [x for x in values.to_pylist() if x is not None]
            out = (np.array(known, np.float64).reshape(len(known), -1) + bias) @ kernel if known else np.zeros((0, kernel.shape[1]))
            if normalise:
                out = out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), eps)
            rows = iter(out.tolist())
            done = pa.array([None if not v.is_valid else next(rows) for v in values], pa.list_(pa.float64()))
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.list_(pa.float64())), done)

    return source.mapInArrow(run, source.schema)
