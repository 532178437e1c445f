"""Greedy chunks of texts under a number of tokens, at sentence or word boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass

# Tokens of a chunk, and length of the chunk of a text without any unit.
CHUNK_TOKENS, FALLBACK = 450, 1000


def word_count(unit: str) -> int:
    """Stand-in for a tokenizer: number of words."""
    return len(unit.split())


def chunk_text(text: str, most: int = CHUNK_TOKENS, count: Callable[[str], int] = word_count) -> list[str]:
    """Chunks of consecutive sentences (parted by '. '), or of words where there is one sentence only.

    A unit that is larger than a chunk makes one of its own. Chunks of sentences end with a full stop.
    """
    sentences = text.split(". ")
    whole = len(sentences) > 1
    glue, end, units = (". ", ".", sentences) if whole else (" ", "", text.split())
    groups: list[list[str]] = []
    room = -1
    for unit in units:
        size = count(unit)
        if not groups or size > room:
            groups.append([])
            room = most
        groups[-1].append(unit)
        room -= size
    # only the last chunk may bring its full stop along
    out = [glue.join(g) + end for g in groups[:-1]]
    out += [last if last.endswith(end) else last + end for last in (glue.join(g) for g in groups[-1:])]
    return out or [text[:FALLBACK]]


def text_chunks(df: DataFrame, key: str, text: str, most: int = CHUNK_TOKENS, count: Callable[[str], int] = word_count) -> DataFrame:
    """(key, chunk_no, chunk) of the texts; NULL texts have no chunks. A narrow pass."""

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            for n, chunk in enumerate(chunk_text(r["text"], most, count)):
                yield r["key"], n, chunk

    source = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return arrow_pass(source, rows, "key long, chunk_no int, chunk string").withColumnRenamed("key", key)
