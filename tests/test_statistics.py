"""Published values of the statistics, brute force on small tables, and edge cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from colophon.functions import special
from colophon.functions.order import hashed_position, sum_before
from colophon.operators import agreement, clusters, contingency, multitest, quality, ranks, records
from colophon.plans import statistics

# Published counts of both groups, statistic, degrees of freedom and p.
PUBLISHED = {
    "position": ([1061, 249, 270, 93, 274], [180, 56, 112, 33, 107], 63.152535429702674, 4, 6.302349706375737e-13),
    "distance": ([516, 281, 363, 331, 456], [35, 7, 92, 78, 276], 262.94555457751386, 4, 1.0573650334064772e-55),
    "strength": ([1359, 163, 25, 17, 18], [219, 44, 12, 13, 13], 49.202126429285386, 4, 5.298488534641688e-10),
    "function": ([0, 16, 8, 270, 14, 56, 18, 42, 441, 509, 17, 51, 4, 501], [1, 14, 4, 101, 2, 30, 14, 24, 112, 128, 5, 22, 1, 30], 138.50638546879594, 13, 4.1907288146761823e-23),
    "depth": ([95, 376, 1476], [38, 190, 260], 98.45936652649311, 2, 4.1669684566883193e-22),
}
CELLS = "dim string, ord int, category string, grp string, n long"


def cells(spark):
    rows = [(d, i, str(i), g, n) for d, (a, b, *_) in PUBLISHED.items() for g, side in (("G1", a), ("G2", b)) for i, n in enumerate(side, 1)]
    return spark.createDataFrame(rows, CELLS)


def test_published_tests(spark):
    got = {r["dim"]: r for r in contingency.chi_square(cells(spark), ["dim"]).collect()}
    for d, (_, _, x, df, p) in PUBLISHED.items():
        assert got[d]["chi2"] == pytest.approx(x, rel=1e-12) and got[d]["df"] == df and got[d]["p"] == pytest.approx(p, rel=1e-9)
    assert got["depth"]["cramers_v"] == pytest.approx(0.20108470384831137, rel=1e-12)


def test_published_adjustment(spark):
    raw = {d: p for d, (*_, p) in PUBLISHED.items()} | {"similarity": 2.668421709183629e-16}
    out = multitest.benjamini_hochberg(spark.createDataFrame([*raw.items(), ("none", None)], "dim string, p double"), "dim", "p")
    got = {r["name"]: r["adjusted"] for r in out.collect()}
    published = {"distance": 6.3441902004388634e-55, "function": 1.2572186444028546e-22, "depth": 8.333936913376638e-22, "similarity": 4.0026325637754434e-16,
                 "position": 7.562819647650885e-13, "strength": 5.298488534641688e-10}
    assert got == pytest.approx(published, rel=1e-12)


def test_published_monte_carlo_p(spark):
    arrays = clusters.count_arrays(cells(spark), ["dim"]).select(F.concat(F.lit("aggregate:"), "dim").alias("test"), "n1", "n2")
    got = {r["test"]: r for r in clusters.monte_carlo(arrays, 100_000).collect()}
    assert all(r["p"] == pytest.approx(9.99990000099999e-06) and r["extreme"] == 0 for r in got.values())
    empty = spark.createDataFrame([("x", [1, 2], [0, 0])], "test string, n1 array<long>, n2 array<long>")
    assert clusters.monte_carlo(empty, 10).collect()[0]["p"] is None


def test_monte_carlo_is_near_the_exact_p():
    # Fisher's exact test of a small table, all tables with its margins listed
    n1, n2 = [3, 1, 0], [1, 2, 4]
    columns, size, total = [4, 3, 4], 4, 11
    stat = lambda row: sum((a - size * c / total) ** 2 / (size * c / total) + (c - a - (total - size) * c / total) ** 2 / ((total - size) * c / total) for a, c in zip(row, columns, strict=True))
    ways = lambda row: math.prod(math.comb(c, a) for a, c in zip(row, columns, strict=True))
    tables = [r for r in itertools.product(*(range(c + 1) for c in columns)) if sum(r) == size]
    exact = sum(ways(r) for r in tables if stat(r) >= stat(n1) - 1e-9) / math.comb(total, size)
    assert clusters.extreme_tables(n1, n2, 40_000, 1) / 40_000 == pytest.approx(exact, abs=0.01)


def test_permutation_of_one_group_has_no_p(spark):
    rows = spark.createDataFrame([(i, "a", "G1") for i in range(5)], "mention_id long, c string, grp string")
    assert clusters.permutation_p(rows, "c", 5).collect()[0]["p"] is None
    both = spark.createDataFrame([(i, "ab"[i % 2], "G1" if i % 2 else "G2") for i in range(12)], "mention_id long, c string, grp string")
    out = clusters.permutation_p(both, "c", 30).collect()[0]
    assert out["observed"] == pytest.approx(12.0) and 0 < out["p"] <= 0.2


def test_tails_agree_with_closed_forms(spark):
    cases = [(df, x) for df in (1, 2, 3, 13, 64, 65, 90, 200) for x in (0.1, 1.0, 7.5, 40.0, 220.0)]
    got = spark.createDataFrame(cases, "df int, x double").select("df", "x", special.chi2_tail(F.col("x"), F.col("df")).alias("p")).collect()

    def closed(df, x):
        h = x / 2
        if df % 2 == 0:
            return sum(math.exp(i * math.log(h) - h - math.lgamma(i + 1)) for i in range(df // 2))
        return math.erfc(math.sqrt(h)) + sum(math.exp((i - 0.5) * math.log(h) - h - math.lgamma(i + 0.5)) for i in range(1, df // 2 + 1))

    for r in got:
        assert r["p"] == pytest.approx(closed(r["df"], r["x"]), rel=1e-8, abs=1e-15)


def test_ranks_agree_with_counting_pairs(spark):
    draw = random.Random(3)
    rows = [("G1" if draw.random() < 0.4 else "G2", float(draw.randrange(12)), f"k{i % 2}") for i in range(300)] + [("G1", None, "k0")]
    df = spark.createDataFrame(rows, "grp string, v double, k string")
    for keys in ([], ["k"]):
        for r in ranks.mann_whitney(df, "grp", "v", keys).collect():
            mine = [x for x in rows if x[1] is not None and (not keys or x[2] == r["k"])]
            one, two = [x[1] for x in mine if x[0] == "G1"], [x[1] for x in mine if x[0] == "G2"]
            u = sum((a > b) + (a == b) / 2 for a in one for b in two)
            assert r["u1"] == u and r["u1"] + r["u2"] == len(one) * len(two) and r["rank_biserial"] == pytest.approx(1 - 2 * u / (len(one) * len(two)))
            assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9)


def test_positions_and_sums_without_one_ordering_task(spark):
    df = spark.createDataFrame([(f"n{i}", i % 3, float(i % 50) + i / 1000) for i in range(500)], "name string, k int, v double")
    got = hashed_position(df, ["k"], "name", "at", "size").collect()
    for k in range(3):
        assert sorted(r["at"] for r in got if r["k"] == k) == list(range(sum(r["k"] == k for r in got)))
        assert {r["size"] for r in got if r["k"] == k} == {sum(r["k"] == k for r in got)}
    for r in sum_before(df.withColumn("w", F.lit(2)), ["k"], "v", "w", "s").collect():
        assert r["s"] == 2 * sum(1 for x in got if x["k"] == r["k"] and x["v"] < r["v"])


def test_published_agreement(spark):
    # Published matrix of 84 pairs and its measures
    depth = {("D", "M"): 6, ("M", "M"): 16, ("M", "S"): 3, ("S", "M"): 6, ("S", "S"): 53}
    rows = [pair for pair, n in depth.items() for _ in range(n)] + [(" ", None)]
    counts = agreement.pair_counts(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    metrics = {r["category"]: r for r in agreement.class_metrics(counts).collect()}
    assert metrics["M"]["f1"] == pytest.approx(0.6808510638297872) and metrics["D"]["precision"] == 0 and metrics["S"]["support"] == 59
    average = {r["average"]: r for r in agreement.average_metrics(agreement.class_metrics(counts)).collect()}
    assert average["macro"]["f1"] == pytest.approx(0.5341967314215234) and average["weighted"]["f1"] == pytest.approx(0.8014140346240253)
    assert average["macro"]["accuracy"] == pytest.approx(0.8214285714285714)
    same = agreement.pair_counts(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b")
    assert agreement.cohen_kappa(same).collect()[0]["kappa"] is None
    with pytest.raises(Exception, match="half blank"):
        agreement.pair_counts(spark.createDataFrame([("x", " ")], "a string, b string"), "a", "b").collect()


ROWS = ("mention_id long, workbook string, source_row int, lable string, journal string, year int, self_citing_article string, self_cited_article string, "
        "self_cited_article_abstract string, citation_content string, citation_position string, citation_distance string, citation_strength double, citation_function string, "
        "citation_depth string, semantic_similarity double, loaded_at string")


def sheet(spark, rows):
    full = [(i, w, n, lable, None, None, title, cited, None, "text", pos, "Same section", strength, "Comparison", "Deep citation", 0.5, "2024-01-01")
            for i, (w, n, lable, title, cited, pos, strength) in enumerate(rows, 1)]
    return spark.createDataFrame(full, ROWS)


def test_records_of_a_sheet(spark):
    rows = sheet(spark, [("w", 2, " G1-1 ", "T", "A", "discussion", 2.0), ("w", 3, None, " ", None, "Methods", None), ("w", 4, "G1-1", "T", "B", "discussion ", 7.0),
                         ("v", 2, "G2-3-x", None, None, None, None)])
    got = {r["mention_id"]: r for r in records.analysis_records(rows).collect()}
    assert [(got[i]["label"], got[i]["grp"], got[i]["field"]) for i in (1, 2, 3, 4)] == [("G1-1", "G1", "1"), ("", "G2", ""), ("G1-1", "G1", "1"), ("G2-3-x", "G2", "3-x")]
    assert [got[i]["article_id"] for i in (1, 2, 3, 4)] == ["w/A0001", "w/A0001", "w/A0002", "v/A0000"]
    assert (got[2]["article_title"], got[2]["cited"], got[4]["article_title"]) == ("T", "A", None)
    assert [got[i]["position"] for i in (1, 2, 3, 4)] == ["Discussion", "Methods", "Discussion", ""]
    assert [got[i]["strength"] for i in (1, 2, 3)] == ["2", None, ">=5"]
    blocks = {r["strength_id"]: r["flags"] for r in quality.anchor_blocks(records.analysis_records(rows)).collect()}
    assert blocks == {"w/S0002": "block_length_differs_from_strength"}


def test_empty_table_gives_empty_or_null_results(spark, tmp_path):
    sheet(spark, []).write.parquet(str(tmp_path / "annotation_rows.parquet"))
    spark.createDataFrame([], "label string, journal string, group_code string, field_no int, field_name string, published_articles long, candidate_articles long").write.parquet(
        str(tmp_path / "journals.parquet"))
    for query in statistics.QUERIES:
        out = query(spark, str(tmp_path)).collect()
        assert len(out) <= 6, query.__name__


def test_totals(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "code string, n long, t string")
    out = quality.with_total(rows, "code")
    assert sorted(tuple(r) for r in out.collect() if r["code"] == "Total") == [("Total", 3, None)]
    assert quality.without_total(out, "code").count() == 2
