import itertools
import json
import random

from colophon.operators.schema_drift import assign, consistent_table, distinct_values, nested_keys, schema_changes

COLUMNS = ["lable", "year"]


def dumps(spark, files):
    """files: (series, file, day, rows); a row is (row_no, fields)."""
    rows = [
        (series, file, f"2024-01-{day:02d} 00:00:00", no, fields if fields is None or isinstance(fields, str) else json.dumps(fields))
        for series, file, day, sheet in files for no, fields in sheet
    ]
    return spark.createDataFrame(rows, "series_id string, file_id string, exported_at string, row_no int, payload string")


def test_rename_inside_a_series_is_applied_although_another_file_has_both_names(spark):
    texts = [f"a remark of some length {i}" for i in range(6)]
    a1 = [(i, {"lable": "G1-1", "notes": t}) for i, t in enumerate(texts)]
    a2 = [(i, {"lable": "G1-1", "remark": t}) for i, t in enumerate(texts)]
    b = [(i, {"lable": "G1-1", "notes": f"note {i}", "remark": f"other {i}"}) for i in range(6)]
    table = consistent_table(dumps(spark, [("A", "a1", 1, a1), ("A", "a2", 2, a2), ("B", "b1", 1, b)]), COLUMNS).collect()
    fields = {f: {k for r in table if r["file_id"] == f for k in json.loads(r["other_fields"])} for f in ("a1", "a2", "b1")}
    assert len(fields["a1"]) == 1 and fields["a1"] == fields["a2"]
    assert len(fields["b1"]) == 2


def test_unrelated_header_of_another_series_stays_out_of_the_column(spark):
    a1 = [(i, {"label": f"G{i % 2 + 1}-1", "year": 2020}) for i in range(6)]
    a2 = [(i, {"lable": f"G{i % 2 + 1}-1", "year": 2020}) for i in range(6)]
    b = [(i, {"label": ["red", "blue"][i % 2], "year": 2021}) for i in range(6)]
    c = [(i, {"label": f"G{i % 2 + 1}-1", "year": 2021}) for i in range(6)]
    table = consistent_table(dumps(spark, [("A", "a1", 1, a1), ("A", "a2", 2, a2), ("B", "b1", 1, b), ("C", "c1", 1, c)]), COLUMNS).collect()
    assert {r["lable"] for r in table if r["series_id"] in "AC"} == {"G1-1", "G2-1"}
    assert {r["lable"] for r in table if r["series_id"] == "B"} == {None}
    assert {json.loads(r["other_fields"])["label"] for r in table if r["series_id"] == "B"} == {"red", "blue"}


def test_no_row_is_lost(spark):
    a = [(1, {"lable": "G1-1"}), (2, None), (3, "{broken"), (4, "[1]"), (5, {}), (None, {"lable": "G1-2"}), (None, {"lable": "G1-3"})]
    b = [(1, {"lable": "G2-1"})]
    table = consistent_table(dumps(spark, [("A", "f", 1, a + a[:2]), ("B", "f", 1, b)]), COLUMNS).collect()
    found = sorted((r["series_id"], r["row_no"] or 0, r["lable"] or "") for r in table)
    assert found == [
        ("A", 0, "G1-2"), ("A", 0, "G1-3"), ("A", 1, "G1-1"), ("A", 2, ""), ("A", 3, ""), ("A", 4, ""), ("A", 5, ""), ("B", 1, "G2-1"),
    ]
    assert {r["other_fields"] for r in table} == {"{}"}


def test_changes_between_files(spark):
    rows = [{"Lable": f"G{i}-1", "Citation  Content": f"a text of some length {i}", "score": i / 10, "old": "x", "n": 1, "meta": {"a": 1, "b": {"c": 2}}} for i in range(8)]
    later = [{"label": r["Lable"], "citation content": r["Citation  Content"], "score": str(r["score"]), "new": [1], "n": 1, "meta": {"a": 1, "b": {"c": 2}}} for r in rows]
    a = [(i, r) for i, r in enumerate(rows)]
    b = [(i, r) for i, r in enumerate(later)]
    found = {tuple(r)[1:] for r in schema_changes(dumps(spark, [("S", "f1", 1, a + a[:3]), ("S", "f2", 2, b)])).drop("turn").collect()}
    assert found == {
        ("f2", "renamed", "lable", "label"), ("f2", "retyped", "score", "score"), ("f2", "removed", "old", ""), ("f2", "added", "", "new"),
    }
    assert schema_changes(dumps(spark, [("S", "f1", 1, a)])).count() == 0


def test_last_delivery_counts_whatever_the_order(spark):
    rows = [("S", "f", "2024-01-01 00:00:00", 1, json.dumps({"lable": v}), t) for v, t in (("late", "2024-02-02 00:00:00"), ("early", "2024-02-01 00:00:00"), (None, None))]
    table = consistent_table(spark.createDataFrame(rows, "series_id string, file_id string, exported_at string, row_no int, payload string, received_at string"), COLUMNS).collect()
    assert [r["lable"] for r in table] == ["late"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "series_id string, file_id string, exported_at string, row_no int, payload string")
    assert consistent_table(empty, COLUMNS).count() == 0 and schema_changes(empty).count() == 0


def test_nested_keys_sketches_and_assignment():
    assert nested_keys({"A": {"b": 1}, "c": 2}) == ["a", "a.b", "c"] and nested_keys([1]) == []
    draw = random.Random(1)
    for n in (0, 5, 63, 3000):
        sketch = sorted(draw.getrandbits(63) for _ in range(n))[:64]
        assert abs(distinct_values(sketch) - n) <= (0 if n < 64 else 0.4 * n)
    for size in (1, 3, 5):
        costs = [[draw.random() for _ in range(size)] for _ in range(size)]
        best = min(sum(costs[i][p[i]] for i in range(size)) for p in itertools.permutations(range(size)))
        assert abs(sum(costs[i][j] for i, j in enumerate(assign(costs))) - best) < 1e-9
