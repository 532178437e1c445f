import random

from colophon.llm import groups


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    parts = {}
    for x in list(parent):
        parts.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, parts.values()))


def found(spark, pairs):
    parts = {}
    for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect():
        parts.setdefault(r["label"], set()).add(r["node"])
    assert all(label in nodes for label, nodes in parts.items())
    return sorted(map(sorted, parts.values()))


def test_paths_a_star_and_a_single_node(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(i, i + 1) for i in range(101, 109)] + [(200, i) for i in range(201, 430)] + [(900, 900)]
    assert found(spark, pairs) == union_find(pairs)


def test_random_graph_agrees_with_union_find(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    assert found(spark, pairs) == union_find(pairs)


def test_empty_graph(spark):
    assert found(spark, []) == []


SCHEMA = "mention_id long, workbook string, source_row int, self_citing_article string, self_cited_article string"


def test_blank_cells_repeat_the_cell_above_and_lookalikes_are_one(spark):
    rows = [
        (7, "w", 2, "Title one", "Entry A"), (5, "w", 3, "  ", "Entry\u00a0A"), (9, "w", 4, None, ""), (4, "v", 2, "Title two", "Entry C"),
        (3, "v", 3, "Title two", "Entry A "), (2, "u", 2, "Other", "Else"), (2, "u", 2, "Other", "Else"), (1, "t", 2, None, None),
    ]
    got = {r["mention_id"]: r["group_id"] for r in groups.related_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {7: 3, 5: 3, 9: 3, 4: 3, 3: 3, 2: 2, 1: 1}


def test_splits_keep_groups_whole_and_meet_the_shares(spark):
    rows = [(i, i - i % 3) for i in range(3000)]
    out = groups.assign_splits(spark.createDataFrame(rows, "mention_id long, group_id long"), {"train": 0.8, "validation": 0.1, "test": 0.1})
    sizes, where = {}, {}
    for r in out.collect():
        sizes[r["split"]] = sizes.get(r["split"], 0) + 1
        where.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(x) == 1 for x in where.values()) and sum(sizes.values()) == 3000
    assert abs(sizes["train"] / 3000 - 0.8) < 0.01 and abs(sizes["test"] / 3000 - 0.1) < 0.01
