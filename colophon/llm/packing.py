"""Problem 8: filling fixed-capacity containers with items.

Method: lexical retrieval packing. Documents are sharded (shards of about SHARD_DOCS documents of one
language); each shard has a BM25 inverted index over token ids. Seeds are taken in pseudorandom order; the
index returns the nearest DEPTH of the shard for a seed, and the unused ones among them fill its window greedily in
the order of their score. A window that stays open by more than OPEN is given up: its documents fill the room
of the others, the largest first and where they fit best, and make new containers where they fit nowhere.

Space or nearness: a smaller OPEN leaves less space unused and more documents without their neighbours.

A document larger than a container is cut at token positions into full pieces, each a container of
its own, and a rest that is packed like a document; no other document is split.

Defined cases: NULL and empty texts have no tokens and are in no container; texts that occur under
several ids are packed once per id.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.tokens import TOKENIZER, token_counts
from colophon.plans.runtime import cut_lineage

SHARD_DOCS = 2000
#: Hash buckets that make one shard.
BUCKETS = 4
K1, B = 1.2, 0.75
#: Share of a shard's documents that count as neighbours of a seed.
DEPTH = 0.1
#: Share of a container that a window may leave empty.
OPEN = 0.12


class Bm25:
    """Inverted index of one shard. Terms of at least half of the documents have no positive weight and aren't indexed."""

    def __init__(self, terms: list[np.ndarray], freqs: list[np.ndarray], sizes: np.ndarray):
        self.terms, self.n = terms, len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        docs = np.repeat(np.arange(self.n), lengths)
        flat = np.concatenate(terms) if self.n else np.empty(0, np.int32)
        tf = np.concatenate(freqs).astype(np.float64) if self.n else np.empty(0)
        self.ids, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
        idf = np.log((self.n - df + 0.5) / (df + 0.5))
        kept = (idf > 0)[inverse]
        docs, tf, inverse = docs[kept], tf[kept], inverse[kept]
        mean = sizes.mean() if self.n else 1.0
        weight = idf[inverse] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[docs] / mean))
        order = np.argsort(inverse, kind="stable")
        self.docs, self.weights = docs[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.where(idf > 0, df, 0))])
        self.rows = np.split(inverse, np.cumsum(np.bincount(docs, minlength=self.n))[:-1]) if self.n else []
        self.found: dict[int, np.ndarray] = {}

    def scores(self, doc: int) -> np.ndarray:
        """BM25 scores of all documents of the shard for the terms of one of them."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.rows[doc]]
        if not spans:
            return np.zeros(self.n)
        docs = np.concatenate([self.docs[s] for s in spans])
        return np.bincount(docs, np.concatenate([self.weights[s] for s in spans]), self.n)


    def nearest(self, doc: int) -> np.ndarray:
        """The documents of the highest scores for one of them, the best first: DEPTH of the shard at most. Kept, as each capacity asks again."""
        if doc not in self.found:
            scores = self.scores(doc)
            scores[doc] = 0.0
            most = max(1, int(self.n * DEPTH))
            near = np.argpartition(-scores, most)[:most] if most < self.n else np.arange(self.n)
            near = near[scores[near] > 0]
            self.found[doc] = near[np.lexsort((near, -scores[near]))].astype(np.int32)
        return self.found[doc]


def fill(index: Bm25, sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers of (item, piece_no, from, to) over the items of a shard."""
    containers, rests = [], sizes.astype(np.int64).copy()
    first = np.zeros(len(sizes), np.int64)
    for item in np.flatnonzero(rests > capacity):
        while rests[item] >= capacity:
            at = first[item] * capacity
            containers.append([(int(item), int(first[item]), int(at), int(at + capacity))])
            first[item] += 1
            rests[item] -= capacity
    unused = rests > 0
    windows: list[tuple[int, list[int]]] = []
    for seed in np.random.default_rng(len(sizes)).permutation(len(sizes)):
        if not unused[seed]:
            continue
        unused[seed] = False
        chosen, room = [int(seed)], int(capacity - rests[seed])
        near = index.nearest(int(seed)) if room else np.empty(0, np.int32)
        for i in near[unused[near] & (rests[near] <= room)]:
            if rests[i] <= room:
                chosen.append(int(i))
                unused[i] = False
                room -= int(rests[i])
        windows.append((room, chosen))
    for chosen in closed(windows, rests, capacity):
        containers.append([(i, int(first[i]), int(first[i] * capacity), int(first[i] * capacity + rests[i])) for i in chosen])
    return containers


def closed(windows: list[tuple[int, list[int]]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The windows (room, items) of which at most OPEN is empty; the items of the others go, the largest first, where they fit best."""
    out = [list(items) for room, items in windows if room <= OPEN * capacity]
    rooms = sorted((room, n) for n, room in enumerate(r for r, _ in windows if r <= OPEN * capacity))
    loose = [i for room, items in windows if room > OPEN * capacity for i in items]
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, n = rooms.pop(at)
            out[n].append(i)
        else:
            room, n = capacity, len(out)
            out.append([i])
        if room > size:
            bisect.insort(rooms, (room - size, n))
    return out


def pack(
    documents: DataFrame, capacities: dict[str, int], key: str = "doc_id", text: str = "text", lang: str = "lang", path: str = TOKENIZER
) -> DataFrame:
    """(task_name, container_id, position, key, piece_no, token_from, token_to, n_tokens, capacity).

    ``capacities`` maps a task to its container size in tokens. One shuffle, of token ids, by shard.
    """
    code = F.coalesce(F.lower(F.substring(F.trim(F.col(lang)), 1, 2)), F.lit("xx"))
    known = F.when(code.rlike("^[a-z]{2}$"), code).otherwise("xx")
    counts = {r["c"]: r["n"] for r in documents.groupBy(known.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pairs, at = [], 0
    for c, n in sorted(counts.items()):
        many = max(1, round(n * BUCKETS / SHARD_DOCS))
        pairs += [F.lit(c), F.struct(F.lit(at).cast("long").alias("at"), F.lit(many).cast("long").alias("many"))]
        at += many
    place = F.create_map(*pairs)[known] if pairs else F.lit(None)
    bucket = place["at"] + F.pmod(F.xxhash64(F.col(key)), place["many"]) if pairs else F.lit(0).cast("long")
    tagged = documents.withColumn("_shard", F.floor(bucket / BUCKETS).cast("long"))
    items = token_counts(tagged, key, text, ["_shard"], path, terms=True)
    schema = (
        "task_name string, container_id string, position int, key long, piece_no int, token_from long, token_to long, n_tokens long, capacity long"
    )
    tasks = sorted(capacities.items())
    names = [p.split()[0] for p in schema.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys, sizes = group["key"].to_numpy(), group["n_tokens"].to_numpy().astype(np.int64)
        lists = lambda c: [x.values.to_numpy() for x in group[c].combine_chunks()]
        index = Bm25(lists("terms"), lists("freqs"), sizes)
        shard = group["_shard"][0].as_py()
        out: list[tuple] = []
        for task, capacity in tasks:
            for c, container in enumerate(fill(index, sizes, capacity)):
                for p, (i, piece, a, b) in enumerate(container):
                    out.append((task, f"{task}-{shard}-{c}", p, int(keys[i]), piece, a, b, b - a, capacity))
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return items.groupBy("_shard").applyInArrow(run, schema).withColumnRenamed("key", key)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per task: containers, items, tokens and the share of unused space."""
    return packed.groupBy("task_name", "capacity").agg(
        F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens")
    ).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
