"""Problem 7: splitting oversized items at natural boundaries.

Method: content-defined chunking. A rolling hash over the last WINDOW characters marks landmarks;
a piece ends at the natural boundary nearest to the first landmark between its least and greatest
size, so that an edit alters only the pieces beside it. The next piece begins exactly ``overlap``
characters before the end of the last one (more only to keep a base character with its marks).

Defined cases: NULL gives no row; a text within the limit is one piece, the text itself; text
without any boundary is cut at the limit, never inside a base character and its marks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass

WINDOW = 48
#: A landmark wherever the hash has this many low bits clear: one in 128 characters.
LANDMARK_BITS = 7
_BASE = 0x9E3779B97F4A7C15
#: Natural boundaries from strong to weak; a piece may end behind a match.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t]*\n\s*",
        r"[.!?。！？؟।](?<!\bal\.)(?<!e\.g\.)(?<!i\.e\.)(?<!\b[A-Z]\.)[\"'”’»)\]」』]*(?:\s+|(?=[\u3040-\u9fff]))|\n",
        r"[;；:：|](?:\s+|(?=[\u3040-\u9fff]))|\|",
        r"[,，、]\s*|\s+[–—-]\s+",
        r"\s+",
    )
)


def landmarks(text: str) -> np.ndarray:
    """Positions (ends of windows) whose rolling hash is a landmark; they depend on WINDOW characters only."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * np.uint64(_BASE)
        mixed ^= mixed >> np.uint64(29)
        weights = np.uint64(0x100000001B3) ** np.arange(WINDOW, dtype=np.uint64)
        hashed = np.zeros(len(codes) - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            hashed += mixed[i : i + len(hashed)] * weights[WINDOW - 1 - i]
        hashed ^= hashed >> np.uint64(31)
    return np.flatnonzero((hashed & np.uint64((1 << LANDMARK_BITS) - 1)) == 0) + WINDOW


def _mark(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M" or ch in "‍️"


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text: in order, without gap, none longer than ``limit``."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than it")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    marks = landmarks(text)
    ends = [np.array([m.end() for m in p.finditer(text)], np.int64) for p in BOUNDARIES]
    out, start, covered = [], 0, 0
    while n - start > limit:
        # the least size counts from the end of the last piece, so that overlap never stops progress
        low, high = max(covered + max(1, (limit - overlap) // 2), start + 1), start + limit
        low = min(low, high)
        inside = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high, "right")]
        target = int(inside[0]) if len(inside) else high
        end = 0
        for points in ends:
            near = points[np.searchsorted(points, low) : np.searchsorted(points, high, "right")]
            if len(near):
                end = int(near[np.abs(near - target).argmin()])
                break
        if not end:
            end = high
            while end > low and _mark(text[end]):
                end -= 1
        out.append((start, end))
        covered = end
        begin = max(end - overlap, start + 1)
        while begin > start + 1 and _mark(text[begin]):
            begin -= 1
        start = begin
    out.append((start, n))
    return out


def split_values(
    df: DataFrame, key: str, fields: dict[str, tuple[int, int]], keep_small: bool = False
) -> DataFrame:
    """Pieces of oversized values: (key, field_name, piece_no, n_pieces, start, end, piece).

    ``fields`` maps a column to (limit, overlap) in characters. Values within the limit stay in the JVM
    and are left out, or with ``keep_small`` come out as one piece. Repeated rows of a key count once.
    """
    cells = None
    for field, (limit, overlap) in fields.items():
        part = df.where(F.col(field).isNotNull()).select(
            F.col(key).cast("long").alias("key"), F.lit(field).alias("field_name"), F.col(field).alias("text"),
            F.lit(int(limit)).alias("limit"), F.lit(int(overlap)).alias("overlap"),
        )
        cells = part if cells is None else cells.unionAll(part)
    large = cells.where(F.length("text") > F.col("limit"))

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            text = r["text"]
            cut = pieces(text, r["limit"], r["overlap"])
            for n, (a, b) in enumerate(cut):
                yield r["key"], r["field_name"], n, len(cut), a, b, text[a:b]

    schema = "key long, field_name string, piece_no int, n_pieces int, start int, end int, piece string"
    out = arrow_pass(large, rows, schema)
    if keep_small:
        small = cells.where(F.length("text") <= F.col("limit"))
        zero = F.lit(0)
        out = out.unionAll(
            small.select("key", "field_name", zero.alias("piece_no"), F.lit(1).alias("n_pieces"), zero.alias("start"),
                         F.length("text").alias("end"), F.col("text").alias("piece"))
        )
    return out.dropDuplicates(["key", "field_name", "piece_no"]).withColumnRenamed("key", key)
