"""Problem 5: splits that keep related records together.

Method: frontier breadth-first components. The adjacency lists are hash-partitioned; the nodes
whose hash is the least among their neighbours are seeds and are expanded concurrently, LEVELS
steps a round; where two seeds meet, their labels become an edge of a smaller graph, on which the
next round works in the same way, until no labels collide. Components then go to the splits in the
order of their hash; the few that hold BIG of all rows or more are placed before by size, as their
place decides how nearly the shares can be met.

The search is the same at every size. A node with very many neighbours is no list in one task: the
expansion is a join, whose long keys the adaptive skew join splits, and labels are reduced before they
are shuffled. Nothing but counts and sums of a fixed number of buckets reaches the driver. The output
of each round is checkpointed in the shared folder.

Defined cases: blank cells (NULL, empty, spaces) repeat the last non-blank cell above them in their
workbook; a cell that has none above is linked to nothing. Repeated rows of a mention count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.lookalike import with_canonical
from colophon.operators.fill import fill_down
from colophon.plans.runtime import cut_lineage

LEVELS = 2


def _rank(column: str | Column, turn: int) -> Column:
    return F.xxhash64(F.col(column) if isinstance(column, str) else column, F.lit(turn))


def _expand(edges: DataFrame, turn: int) -> DataFrame:
    """(node, label) after LEVELS steps of concurrent breadth-first search from the seeds of a round."""
    adjacent = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("a").alias("next"))
    )
    nodes = adjacent.groupBy("node").agg(F.min(_rank("next", turn)).alias("least"))
    labels = nodes.select(
        "node", F.when(_rank("node", turn) < F.col("least"), F.struct(_rank("node", turn).alias("rank"), F.col("node").alias("label"))).alias("seed")
    )
    for _ in range(LEVELS):
        frontier = labels.where(F.col("seed").isNotNull())
        reached = (
            adjacent.join(frontier, "node").select(F.col("next").alias("node"), "seed").groupBy("node").agg(F.min("seed").alias("reached"))
        )
        labels = labels.join(reached, "node", "left").select("node", F.coalesce("seed", "reached").alias("seed"))
    return labels.select("node", F.coalesce("seed.label", "node").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of an undirected graph ``edges(a, b)`` of longs: label is one node of its component.

    Self-edges make single nodes. Each round maps nodes to seeds and keeps the edges between seeds.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mapping = nodes.select("node", F.col("node").alias("label"))
    links = pairs.where(F.col("a") != F.col("b"))
    turn = 0
    while not links.isEmpty():
        step = cut_lineage(_expand(links, turn))
        moved = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
        mapping = cut_lineage(mapping.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        end = lambda c, to: step.select(F.col("node").alias(c), F.col("label").alias(to))  # noqa: B023, E731
        links = cut_lineage(
            links.join(end("a", "x"), "a").join(end("b", "y"), "b").where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        turn += 1
    return mapping


def related_groups(
    df: DataFrame, key: str = "mention_id", sheet: str = "workbook", row: str = "source_row",
    fields: tuple[str, ...] = ("self_citing_article", "self_cited_article"),
) -> DataFrame:
    """(key, group_id): the least key among all records linked by an equal value of any of ``fields``.

    Values are equal if their canonical forms (problem 6) are, outer white space dropped. A value is
    named by the least key that holds it, so the graph has one node per record that is the first of
    its value, and one edge per pair of such records that some record joins.
    """
    base = df.select(F.col(key).cast("long").alias("_key"), F.col(sheet).alias("_wb"), F.col(row).alias("_row"), *fields)
    for f in fields:
        base = with_canonical(base, f, f)
        base = base.withColumn(f, F.regexp_replace(F.col(f), r"(?U)^\s+|\s+$", ""))
    filled = fill_down(base, "_wb", "_row", list(fields))
    hashed = filled.groupBy("_key").agg(*[F.max(F.unhex(F.md5(F.col(f)))).alias(f) for f in fields])
    hashed = cut_lineage(hashed)
    first = hashed
    for f in fields:
        named = hashed.where(F.col(f).isNotNull()).groupBy(f).agg(F.min("_key").alias(f"_first_{f}"))
        first = first.join(named, f, "left")
    first = cut_lineage(first.select("_key", *[F.coalesce(f"_first_{f}", "_key").alias(f) for f in fields]))
    edges = None
    for f in fields[1:]:
        part = first.select(F.col(fields[0]).alias("a"), F.col(f).alias("b"))
        edges = part if edges is None else edges.unionAll(part)
    if edges is None:
        edges = first.select(F.col(fields[0]).alias("a"), F.col(fields[0]).alias("b"))
    labels = components(edges).withColumnRenamed("node", fields[0])
    tagged = first.select("_key", fields[0]).join(labels, fields[0])
    names = tagged.groupBy("label").agg(F.min("_key").alias("group_id"))
    return tagged.join(names, "label").select(F.col("_key").alias(key), "group_id")


#: Components with at least this share of all rows are placed one by one; there are at most 1 / BIG of them.
BIG = 0.002
BUCKETS = 4096


def assign_splits(groups: DataFrame, shares: dict[str, float], key: str = "mention_id") -> DataFrame:
    """(key, group_id, split): whole groups go to splits, the shares of rows met as nearly as groups allow.

    Big groups (bounded in number) are placed by size where most room is left; all others follow in the
    order of their hash and fill the room that remains.
    """
    spark = groups.sparkSession
    total_share = sum(shares.values())
    if not shares or total_share <= 0:
        raise ValueError("shares must be positive")
    sizes = cut_lineage(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).head()[0] or 0
    room = {s: total * w / total_share for s, w in sorted(shares.items())}
    big = {}
    for r in sorted(sizes.where(F.col("n") >= max(2, BIG * total)).collect(), key=lambda r: (-r["n"], r["group_id"])):
        split = max(room, key=lambda s: (room[s], s))
        big[r["group_id"]] = split
        room[split] -= r["n"]
    placed = spark.createDataFrame(list(big.items()), "group_id long, big string")
    rest = sizes.join(F.broadcast(placed), "group_id", "left_anti").withColumn("h", F.xxhash64("group_id", F.lit("split")))
    rest = rest.withColumn("bucket", F.shiftrightunsigned("h", 52))
    per = rest.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inner = Window.partitionBy("bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rest.join(F.broadcast(per.select("bucket", "before")), "bucket").withColumn(
        "at", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("n") / 2
    )
    free = {s: max(0.0, x) for s, x in room.items()}
    left, open_room = rest.agg(F.sum("n")).head()[0] or 0, sum(free.values()) or 1.0
    split, upto, marks = F.lit(max(free, key=lambda s: (free[s], s))), 0.0, []
    for s, x in free.items():
        upto += x * left / open_room
        marks.append((s, upto))
    for s, bound in reversed(marks):
        if free[s] > 0:
            split = F.when(F.col("at") < bound, s).otherwise(split)
    chosen = ordered.select("group_id", split.alias("split")).unionAll(placed.select("group_id", F.col("big").alias("split")))
    return groups.join(chosen, "group_id").select(key, "group_id", "split")
