"""Every operator on nulls, blank and very long texts, repeated rows, empty tables and columns whose names clash with its own."""

import pytest
from pyspark.sql import functions as F

from colophon.llm import chunking, encoding, groups, lookalike, mixing, overlap, packing, sentences, truncation

CLASHES = ["key", "tid", "norm", "h", "h1", "range", "_source", "_shard", "_wb", "_row", "_key", "kind", "item", "n", "at", "cell", "size", "reason", "field_name", "piece", "label", "node", "source", "block", "text_2"]
LONG = "Some words of a long text, (Smith 2020) and more. " * 4000
ROWS = [(1, "w", 1, "A short text. It ends here.", "en", "s1"), (1, "w", 1, "A short text. It ends here.", "en", "s1"), (2, "w", 2, None, None, None), (3, "w", 3, "", "en", "s1"),
        (4, "v", 1, " \n\t ", "EN", "s2"), (5, "v", 2, LONG, "en", "s2"), (6, None, None, "ﬁne wﾙde “x”", "zz", "s1"), (7, "v", 3, "A short text. It ends here.", "en", "s2"), (8, "v", 4, "�\u0000", "en", "s1")]


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, "doc_id long, workbook string, source_row int, body string, lang string, origin string")
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES]) if clashes else df


def targets(spark):
    return spark.createDataFrame([("m", "s1", 0.5, 2), ("m", "s2", 0.5, 3)], "mix_name string, source string, target_share double, max_repeats int")


OPERATORS = {
    "truncation": lambda s, df: truncation.truncated_values(df, "doc_id", "body", "workbook", None),
    "overlap": lambda s, df: overlap.cross_split_pairs(df, "doc_id", "body", F.col("origin") == "s1"),
    "encoding": lambda s, df: encoding.garbled_values(df, "doc_id", "body", None),
    "groups": lambda s, df: groups.related_groups(df, "doc_id", "workbook", "source_row", ("body", "lang")),
    "lookalike": lambda s, df: lookalike.canonical_values(df, "doc_id", ["body", "lang"]),
    "canonical column": lambda s, df: lookalike.with_canonical(df, "body", "body_2").select("doc_id", "body_2"),
    "chunking": lambda s, df: chunking.split_values(df, "doc_id", {"body": (500, 50)}),
    "packing": lambda s, df: packing.pack(df, {"small": 512}, "doc_id", "body", "lang"),
    "mixing": lambda s, df: mixing.mixed(df, targets(s), "doc_id", "body", "origin"),
    "sentences": lambda s, df: sentences.sentence_units(df, "doc_id", "body", "lang"),
}


def plain(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    run = OPERATORS[name]
    with_clashes = plain(run(spark, frame(spark, ROWS)))
    assert with_clashes == plain(run(spark, frame(spark, ROWS, clashes=False)))
    assert plain(run(spark, frame(spark, []))) == []


def test_results_of_the_edge_rows(spark):
    df = frame(spark, ROWS)
    assert {(r["key_left"], r["key_right"], r["kind"]) for r in OPERATORS["overlap"](spark, df).collect()} == {(1, 7, "exact")}
    assert {r["doc_id"]: r["group_id"] for r in OPERATORS["groups"](spark, df).collect()}.keys() == {1, 2, 3, 4, 5, 6, 7, 8}
    assert [r["key"] for r in OPERATORS["encoding"](spark, df).collect()] == [8]
    assert {r["key"] for r in OPERATORS["lookalike"](spark, df).collect()} == {6}
    assert {r["doc_id"] for r in OPERATORS["packing"](spark, df).collect()} == {1, 4, 5, 6, 7, 8}
    assert {r["doc_id"] for r in OPERATORS["sentences"](spark, df).collect()} == {1, 5, 6, 7, 8}
    assert {r["doc_id"] for r in OPERATORS["chunking"](spark, df).collect()} == {5}
