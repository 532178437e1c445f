"""Problem 9: mixing sources to target weights.

Method: the documents of each source are put in pseudorandom order and their tokens form one stream,
repeated ``max_repeats`` times and packed into blocks of exactly BLOCK_TOKENS tokens; a block may run from
the end of one repetition into the next. Each output shard draws the counts of its sources
multinomially, on condition of the exact totals (a balanced tree of multivariate hypergeometric splits,
so any shard draws its own counts without the others). Its slots are mapped to blocks through the
source's pseudorandom index permutations, one for each repetition, and joined with the stream by index.

As all blocks are full, the shares of tokens are the shares of slots. The total is the largest at which no
source is repeated more than its ``max_repeats`` times, or a smaller one that is asked for.

Defined cases: NULL and empty texts have no tokens and are never drawn; a source without tokens
makes its mix empty, as its share can't be met; shares are relative to their sum; the tokens at the
very end that fill no block are left out (fewer than BLOCK_TOKENS of a source).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.tokens import TOKENIZER, token_counts
from colophon.plans.runtime import arrow_pass, cut_lineage

BLOCK_TOKENS = 128
SHARD_SLOTS = 64
#: Hash ranges of a source whose sums are accumulated first.
RANGES = 256
SEED = 20


def permuted(index: int, size: int, key: int) -> int:
    """Image of ``index`` under a pseudorandom permutation of range(size): a Feistel network with cycle walking."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = index >> half, index & mask
        for turn in range(4):
            mixed = (right * 0x9E3779B1 + key * 0x85EBCA77 + turn * 0xC2B2AE3D) & 0xFFFFFFFFFFFFFFFF
            mixed ^= mixed >> 29
            mixed = mixed * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            left, right = right, left ^ (mixed >> 32) & mask
        index = left << half | right
        if index < size:
            return index


#: Population up to which numpy draws hypergeometric numbers; beyond it their normal limit is used, whose error is under one in a million there.
EXACT_DRAW = 1_000_000_000


def split_counts(have: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``size`` items drawn without replacement; totals of any magnitude."""
    out, rest = np.zeros(len(have), np.int64), int(have.sum())
    for i, good in enumerate(map(int, have)):
        bad = rest - good
        if rest < EXACT_DRAW:
            n = int(rng.hypergeometric(good, bad, size)) if rest and size else 0
        else:
            p = good / rest
            spread = (size * p * (1 - p) * (rest - size) / max(1, rest - 1)) ** 0.5
            n = round(size * p + spread * float(rng.standard_normal()))
        out[i] = n = min(max(n, size - bad, 0), good, size)
        rest, size = bad, size - n
    return out


def shard_counts(totals: list[int], shards: int, shard: int, seed: int) -> tuple[list[int], list[int]]:
    """(slots of each source in shards before this one, slots of each source in this one)."""
    have, before = np.array(totals, np.int64), np.zeros(len(totals), np.int64)
    low, high, slots = 0, shards, int(have.sum())
    size = lambda a, b: min(b * SHARD_SLOTS, slots) - min(a * SHARD_SLOTS, slots)
    while high - low > 1:
        mid = (low + high) // 2
        left = split_counts(have, size(low, mid), np.random.default_rng([seed, low, high]))
        if shard < mid:
            have, high = left, mid
        else:
            before, have, low = before + left, have - left, mid
    return before.tolist(), have.tolist()


def block_of(n: int, tokens: int, repeats: int, key: int) -> int:
    """Block of the n-th slot of a source: the full blocks that begin in the same repetition change places."""
    turn = n * BLOCK_TOKENS // tokens
    first, end = -(-turn * tokens // BLOCK_TOKENS), min(-(-(turn + 1) * tokens // BLOCK_TOKENS), repeats * tokens // BLOCK_TOKENS)
    return first + permuted(n - first, end - first, key + 7919 * turn)


def parts_of(block: int, tokens: int) -> Iterator[tuple[int, int, int, int]]:
    """(take, cell, from, to) of a block: its stretches of the stream, cut at cells of BLOCK_TOKENS and at repetitions."""
    at, end = block * BLOCK_TOKENS, (block + 1) * BLOCK_TOKENS
    while at < end:
        take, place = divmod(at, tokens)
        cell = place // BLOCK_TOKENS
        stop = min(place + end - at, (cell + 1) * BLOCK_TOKENS, tokens)
        yield take, cell, place, stop
        at += stop - place


def token_cells(documents: DataFrame, key: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """(source, cell, key, at, n_tokens): documents of each cell of BLOCK_TOKENS of a source's stream; ``at`` is the place of the first token.

    Prefix sums run over RANGES hash ranges of a source and then inside a range, so that a hot source is
    never ordered by one task.
    """
    tagged = documents.where(F.col(source).isNotNull()).withColumn("_source", F.col(source))
    counts = token_counts(tagged, key, text, ["_source"], path).withColumn("h", F.xxhash64("key", F.lit(SEED)))
    counts = cut_lineage(counts.withColumn("range", F.pmod(F.shiftright("h", 40), F.lit(RANGES))))
    before = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_source", "range").agg(F.sum("n_tokens").alias("n")).select(
        "_source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("_source", "range").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(ranges, ["_source", "range"]).select(
        "_source", "key", "n_tokens", (F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("at")
    )
    cell = F.explode(F.sequence(F.floor(F.col("at") / BLOCK_TOKENS), F.floor((F.col("at") + F.col("n_tokens") - 1) / BLOCK_TOKENS)))
    return placed.select(F.col("_source").alias("source"), cell.alias("cell"), "key", "at", "n_tokens")


def slot_totals(targets: list[dict], tokens: dict[str, int], most_tokens: int | None = None) -> dict[str, int]:
    """Slots of each source of a mix: shares by largest remainder, within the sources' repetitions."""
    weight = sum(t["target_share"] for t in targets)
    shares = {t["source"]: t["target_share"] / weight for t in targets if t["target_share"] > 0}
    cap = {t["source"]: t["max_repeats"] * tokens.get(t["source"], 0) // BLOCK_TOKENS for t in targets}
    n = min((int(cap[s] / shares[s] + 1e-9) for s in shares), default=0)
    if most_tokens is not None:
        n = min(n, most_tokens // BLOCK_TOKENS)
    exact = {s: n * x for s, x in shares.items()}
    slots = {s: min(int(x + 1e-9), cap[s]) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(slots.values()) < n and slots[s] < cap[s]:
            slots[s] += 1
    return slots


def mixed(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    path: str = TOKENIZER, most_tokens: int | None = None,
) -> DataFrame:
    """(mix_name, shard, slot, source, block, take, key, token_from, token_to, n_tokens).

    ``targets`` has mix_name, source, target_share, max_repeats; it and the token sums of its sources are
    the only things collected. ``take`` counts the repetitions of a document from 0 and is under max_repeats.
    """
    spark = documents.sparkSession
    wanted = [r.asDict() for r in targets.select("mix_name", "source", "target_share", "max_repeats").where("source is not null").collect()]
    names = sorted({t["source"] for t in wanted})
    chosen = documents.where(F.col(source).isin(names)) if names else documents.where(F.lit(False))
    cells = cut_lineage(token_cells(chosen, key, text, source, path))
    # each document counts in the cell in which it begins
    first = F.floor(F.col("at") / BLOCK_TOKENS) == F.col("cell")
    tokens = {r["source"]: r["n"] for r in cells.where(first).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    schema = "mix_name string, shard long, slot int, source string, block long, take long, cell long, lo long, hi long"
    slots = None
    for mix in sorted({t["mix_name"] for t in wanted}):
        rows_of = sorted((t for t in wanted if t["mix_name"] == mix), key=lambda t: t["source"])
        totals = slot_totals(rows_of, tokens, most_tokens)
        order = [s for s in sorted(totals) if totals[s] > 0]
        counts, sizes = [totals[s] for s in order], [(tokens[s], next(t["max_repeats"] for t in rows_of if t["source"] == s)) for s in order]
        shards, seed = -(-sum(counts) // SHARD_SLOTS), zlib.crc32(mix.encode()) + SEED
        part = spark.range(0, shards, 1, max(1, min(shards // 64, 2000)))

        def draw(batch: list[dict], mix=mix, order=order, counts=counts, sizes=sizes, shards=shards, seed=seed) -> Iterator[tuple]:
            keys = [zlib.crc32(s.encode()) for s in order]
            for r in batch:
                before, own = shard_counts(counts, shards, r["id"], seed)
                picks = [(i, before[i] + k) for i in range(len(order)) for k in range(own[i])]
                np.random.default_rng([seed, shards, r["id"], 1]).shuffle(picks)
                for slot, (i, n) in enumerate(picks):
                    i = int(i)
                    block = block_of(int(n), *sizes[i], keys[i] + seed)
                    for take, cell, lo, hi in parts_of(block, sizes[i][0]):
                        yield mix, r["id"], slot, order[i], block, take, cell, lo, hi

        part = arrow_pass(part, draw, schema)
        slots = part if slots is None else slots.unionAll(part)
    if slots is None:
        slots = spark.createDataFrame([], schema)
    start, stop = F.greatest(F.lit(0), F.col("lo") - F.col("at")), F.least(F.col("n_tokens").cast("long"), F.col("hi") - F.col("at"))
    joined = slots.join(cells, ["source", "cell"]).withColumn("token_from", start).withColumn("token_to", stop).where("token_from < token_to")
    return joined.select(
        "mix_name", "shard", "slot", "source", "block", "take", F.col("key").alias(key), "token_from", "token_to",
        (F.col("token_to") - F.col("token_from")).alias("n_tokens"),
    )


def share_report(selection: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per mix and source: target and reached share of tokens, and how often a document was taken at most."""
    per = selection.groupBy("mix_name", "source").agg(
        F.sum("n_tokens").alias("tokens"), (F.max("take") + 1).alias("most_taken"), F.countDistinct(key).alias("documents")
    )
    whole = Window.partitionBy("mix_name")
    return (
        targets.select("mix_name", "source", "target_share", "max_repeats").join(per, ["mix_name", "source"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("reached_share", F.round(F.try_divide("tokens", F.sum("tokens").over(whole)), 6))
    )
