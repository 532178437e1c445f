"""Hooks for models outside the engine: a context filter and an embedding, with retries, fallback and counters.

The caller supplies the function; the engine brings batches, order and failures. Without one the fallback
path is taken, so a plan runs (and can be tested) where no model is at hand.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators.chunks import CHUNK_TOKENS, chunk_text, word_count
from colophon.plans.runtime import arrow_pass

#: Longest pause between two attempts, in seconds.
LONGEST = 10.0


def pause(attempt: int) -> float:
    """Seconds to wait after a failed attempt, from 1: doubled each time up to LONGEST."""
    return min(2.0 ** (attempt - 1), LONGEST)


def attempted(call: Callable[[str], tuple[str, int]], text: str, attempts: int, wait: Callable[[float], None] = time.sleep) -> tuple[str, int, str | None]:
    """(result, tokens, fault): the first result that isn't blank; the text itself, with the last fault, if all attempts fail."""
    fault = "blank result"
    for n in range(1, attempts + 1):
        try:
            result, tokens = call(text)
            if result and result.strip():
                return result.strip(), tokens, None
            fault = "blank result"
        except Exception as error:
            fault = f"{type(error).__name__}: {error}"
        if n < attempts:
            wait(pause(n))
    return text, 0, fault


def filtered_context(df: DataFrame, key: str, text: str, call: Callable[[str], tuple[str, int]] | None = None, attempts: int = 3) -> DataFrame:
    """(key, filtered, tokens, fault): the context of each row as the caller's filter leaves it.

    NULL and blank texts come out empty without a call. A row whose attempts all fail keeps its text and carries the fault;
    the run goes on. Without ``call`` every row keeps its text.
    """

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            value = r["text"]
            if value is None or not value.strip():
                yield r["key"], "", 0, None
            elif call is None:
                yield r["key"], value, 0, None
            else:
                yield r["key"], *attempted(call, value, attempts)

    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return arrow_pass(source, rows, "key long, filtered string, tokens long, fault string").withColumnRenamed("key", key)


def filter_totals(filtered: DataFrame, original: DataFrame, key: str, text: str) -> DataFrame:
    """Rows, tokens over all calls, rows that came out as they went in, and failed rows."""
    both = filtered.join(original.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), key)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if((F.col("filtered") == F.col("_text")) & (F.col("_text") != "")).alias("unchanged"), F.count_if(F.col("fault").isNotNull()).alias("failed"),
    )


def embedded(
    df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], most: int = CHUNK_TOKENS, count: Callable[[str], int] = word_count
) -> DataFrame:
    """(key, vector, fault): unweighted mean of the vectors of a text's chunks. ``load`` makes the model once per task.

    NULL and blank texts have no vector; a text that fails has none and carries the fault.
    """

    def rows(batch: list[dict]) -> Iterator[tuple]:
        model = load()
        for r in batch:
            chunks = [c for c in chunk_text(r["text"], most, count) if c.strip()] if r["text"] else []
            if not chunks:
                yield r["key"], None, None
                continue
            try:
                vectors = model(chunks)
                yield r["key"], [sum(x) / len(vectors) for x in zip(*vectors, strict=True)], None
            except Exception as error:
                yield r["key"], None, f"{type(error).__name__}: {error}"

    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return arrow_pass(source, rows, "key long, vector array<double>, fault string").withColumnRenamed("key", key)


def pooled(first: list[list[float]], last: list[list[float]], way: str = "cls") -> list[float]:
    """One vector of the token vectors of the first and last layer: 'cls' halves the sum of the first tokens, 'mean' averages the sums over the tokens."""
    if way == "cls":
        return [(a + b) / 2 for a, b in zip(first[0], last[0], strict=True)]
    if way == "mean":
        sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(first, last, strict=True)]
        return [sum(c) / len(sums) for c in zip(*sums, strict=True)]
    raise ValueError(f"no such pooling: {way}")
