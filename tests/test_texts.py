import pytest
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import chunks, citations, lines, vectors
from colophon.plans.labels import whitening


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("x")).collect()[0]["x"]


def test_normalising(spark):
    assert one(spark, "（ﬁx­​ed） ﬅ", T.plain_characters) == "(fixed) ft"
    assert one(spark, "  a \u000b\n b\u0085", T.strip) == "a \u000b\n b"
    assert one(spark, "a  b --– c", T.clean_context) == "a b   c"
    assert one(spark, "Lock- down is post– war", T.rejoin_hyphens) == "Lockdown is postwar"
    assert one(spark, "A  B c", T.compare_key) == "abc"
    assert one(spark, None, T.cell_text) == ""
    assert one(spark, "2020, 2020a; 1999 x2001 20200", T.year_count) == 3
    assert [one(spark, v, T.starts_upper) for v in ("1 Ab", "1 ab", "方A", "123")] == [True, False, False, False]
    assert tuple(one(spark, "a)((b)(", T.paren_profile)) == (2, 2)


def test_flag_order(spark):
    long = "w " * 200
    assert one(spark, "short", T.context_flag) == "short"
    assert one(spark, long + "-" * 11 + " 2019 2020", T.context_flag) == "dashes"
    assert one(spark, long + " 2019 2020", T.context_flag) == "years"
    assert one(spark, long, T.context_flag) == ""


def test_sentences_by_the_plain_and_the_bounded_rule():
    assert citations.plain_sentences("A b. C (d. e) f! G et al. h 0.05 i") == ["A b.", "C (d. e) f!", "G et al. h 0.", "05 i"]
    assert citations.plain_sentences("Open (a. b. c") == ["Open (a. b. c"] and citations.plain_sentences(None) == [] and citations.plain_sentences(" ") == []
    text = "First. In Smith et al. (2020) we see. Last"
    at = text.index("(2020")
    assert citations.enclosing_sentence(text, at, at + 6) == "(2020) we see."
    assert citations.enclosing_sentence(text, at, at + 6, intended=True) == "In Smith et al. (2020) we see."


@pytest.mark.parametrize("text", [
    "as Smith (2020) shows", "Smith et al. (2020)", "Smith et al. (2019, 2020a)", "Smith (2018, 2020, 2021b)", "Smith (2020, p. 3)", "(Smith, 2020)", "(Smith, 2019, 2020)",
    "(Smith et al., 2020, p. 3)", "Smith, Jones, and Brown (2020)", "Smith and Jones (2020)", "Smith & Jones (2020)", "(Smith, Jones, & Brown, 2020)",
    "(Smith & Jones, 2020; Other, 2011)", "Smith et al. 2020", "Smith & Jones, 2020", "Smith, 2020; Other, 2011", "(see Other, 2011; Smith, 2020b)", "SMITH 2020",
    "Smith and O’Leary (2020)", "Smith and Al-Omari, 2020",
])
def test_each_form_of_a_mention(text):
    assert citations.find_mentions(text, "Smith", 2020)


@pytest.mark.parametrize("text", ["Smithson (2020)", "Smith (2019)", "Smith (20201)", "Smith found in 2020", "@Smith 2020", "Goldsmith, 2020", "Smith wrote (2020)"])
def test_what_is_no_mention(text):
    assert not citations.find_mentions(text, "Smith", 2020)


def test_hyphens_and_apostrophes_of_names():
    hit = lambda name, text, **x: bool(citations.find_mentions(text, name, 2020, **x))
    assert hit("Jean-Luc", "Jean‐Luc (2020)") and hit("Jean-Luc", "Jean- Luc (2020)") and hit("Öström", "öström, 2020")
    assert not hit("O'Leary", "O’Leary (2020)") and hit("O'Leary", "O’Leary (2020)", intended=True)


def test_reference_lists(spark):
    text = ("See References in text\n\n  References:\nleading words 2001\nSmith, J. (2020). A title\nthat goes on\n12. Jones, K. (2019). Numbered\nÖström, A.‐B., & Al-Omari (n.d.). Later 2021a\n"
            "Appendix A\nHidden, H. (2000). Not seen")
    df = spark.createDataFrame([(1, text), (2, None), (3, "no list"), (4, "")], "d int, t string")
    got = [(r["d"], r["ref_order"], r["ref_text"]) for r in lines.reference_entries(df, "d", "t").orderBy("d", "ref_order").collect()]
    assert got == [(1, 1, "leading words 2001"), (1, 2, "Smith, J. (2020). A title that goes on 12. Jones, K. (2019). Numbered"), (1, 3, "Öström, A.‐B., & Al-Omari (n.d.). Later 2021a")]
    entries = [("Smith, J. (2020). x 1999", "Smith", 2020), ("O’Leary, T., Doe. 2018a. y", "O’Leary", 2018), ("Jean-Luc P (1999) z", "Jean-Luc P", 1999), ("no year here", "no year here", -1), ("123", "", -1), ("", "", -1)]
    found = spark.createDataFrame([(e,) for e, *_ in entries], "ref_text string").select("ref_text", lines.first_author(F.col("ref_text")).alias("a"), lines.entry_year(F.col("ref_text")).alias("y"))
    assert {r["ref_text"]: (r["a"], r["y"]) for r in found.collect()} == {e: (a, y) for e, a, y in entries}
    refs = spark.createDataFrame([("A (2020). Jour nal-of Some  Things",), ("B (2020). Journal of Other Things",), ("C (2019). Journal of Some Things",)], "ref_text string")
    assert [r["surname"] for r in lines.target_references(refs, ["Journal of Some"], 2020).collect()] == ["A"]
    assert lines.target_references(refs, [], 2020).count() == 0


def test_mentions_to_rows(spark):
    paragraphs = spark.createDataFrame([
        ("1", 0, "Intro text. Smith (2020) and Jones (2019) agree."), ("1", 2, "Smith (2020) again. Nothing here."), ("1", 3, "Later Jones (2019)."), ("1", 9, "References"), ("1", 10, "Smith (2020) not seen"),
        ("2", 0, "Only Lee (2001)."),
    ], "doc_id string, para_idx int, text string")
    targets = spark.createDataFrame([("1", 1, "S", "Smith", 2020), ("1", 2, "J", "Jones", 2019), ("1", 3, "N", "Never", 2000), ("1", 4, "E", "", 2000), ("2", 1, "L", "Lee", 2001)],
                                    "doc_id string, ref_order int, ref_text string, surname string, ref_year int")
    headings = spark.createDataFrame([("1", 2, "Methods")], "doc_id string, index int, text string")
    rows = {(r["doc_id"], r["ref_text"], r["para_idx"]): r for r in citations.annotate(paragraphs, targets, headings).collect()}
    assert set(rows) == {("1", "S", 0), ("1", "J", 0), ("1", "S", 2), ("1", "J", 3), ("1", "N", -1), ("1", "E", -1), ("2", "L", 0)}
    assert rows["1", "S", 0]["distance"] == "SameSentence" and rows["1", "S", 2]["distance"] == "SameSection" and rows["2", "L", 0]["distance"] == "only one self-citation"
    assert rows["1", "N", -1]["distance"] == "DifferentSection" and rows["1", "S", 0]["strength"] == 2 and rows["1", "S", 0]["section_name"] == "Unknown" and rows["1", "S", 2]["section_name"] == "Methods"
    assert rows["1", "S", 2]["context"].startswith("Intro text. Smith (2020) and Jones")


def test_window_and_join_form_of_distance_agree(spark):
    rows = [(i, f"d{i % 3}", f"r{(i * 7) % 4 if i % 3 else 0}", ["", "s1", "s2", "s1 "][i % 4], [-1, 0, 1, 2, 2][i % 5], ["", "A", "B"][i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id int, doc_id string, ref_text string, sentence string, para_idx int, section_name string")
    a = {r["row_id"]: r["distance"] for r in citations.distance(df).collect()}
    assert a == {r["row_id"]: r["distance"] for r in citations.distance_by_join(df).collect()}


def test_abstracts(spark):
    docs = {
        "inline": ["Title", "Abstract: First part", "second part.", "Keywords: a, b", "Body"], "after": ["Title", "ABSTRACT", "———", "The text.", "1 Introduction", "Body"],
        "spaced": ["A B S T R A C T", "Spaced text.", "References"], "none": ["Title", "Body"], "loose": ["Graphical abstract here", "The text.", "INTRODUCTION", "x"],
    }
    rows = [(d, "body", i, t) for d, ts in docs.items() for i, t in enumerate(ts)] + [("none", "textbox", 0, "Abstract"), ("none", "textbox", 1, "In the box."), ("blank", "body", 0, None)]
    got = {r["doc_id"]: r["abstract"] for r in citations.abstracts(spark.createDataFrame(rows, "doc_id string, source string, para_idx int, text string")).collect()}
    assert got == {"inline": "First part second part.", "after": "——— The text.", "spaced": "Spaced text.", "none": "In the box.", "loose": "The text."}


def test_headings_by_style(spark):
    run = lambda text, bold=True, italic=False, size=11.0, fonts=("Times New Roman",): (text, list(fonts), size, bold, italic)
    cases = [("2 Methods", [run("2 Methods")], True), ("Methods", [run("Methods", bold=False)], False), ("Methods", [run("Methods", italic=True)], False), ("Abstract.", [run("Abstract.")], False),
             ("methods", [run("methods")], False), ("One Two three four five six", [run("One Two three four five six")], False), ("Results", [run("Resul"), run("ts", bold=False)], True),
             ("Results", [run("Results", size=None)], True), ("Results", [run("Results", fonts=("Arial",))], False), ("Results", [], False)]
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], "i int, t string, r array<struct<text:string,fonts:array<string>,size_pt:double,bold:boolean,italic:boolean>>")
    got = df.select("i", citations.is_heading(F.col("t"), F.col("r")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == [h for *_, h in cases]


def test_chunks():
    assert chunks.chunk_text("a b. c d e. f", 3) == ["a b.", "c d e.", "f."]
    assert chunks.chunk_text("a b. c. d e.", 3) == ["a b. c.", "d e."]
    assert chunks.chunk_text("one two three four five", 2) == ["one two", "three four", "five"]
    assert chunks.chunk_text("  ", 2) == ["  "] and chunks.chunk_text("", 2) == [""]
    assert chunks.chunk_text("a b c d. e", 2) == ["a b c d.", "e."]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (9000, [-2.0, 0.5], 0), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, 2.0], None)], "k long, v array<float>, l int")
    pairs = vectors.neighbour_pairs(df, "k", "v", "l")
    got = {(r["key_a"], r["key_b"]): (r["c"], r["s"]) for r in pairs.select("key_a", "key_b", vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.sign_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert set(got) == {(1, 2), (2, 9000), (4, 5)}
    assert got[1, 2][0] == pytest.approx(0.5**0.5) and got[2, 9000][1] == pytest.approx(0.0) and got[4, 5] == (None, None)
    white = whitening(2, 3)
    out = {r["k"]: r["w"] for r in vectors.whitened(df, "v", "w", white).collect()}
    assert out[4] is None and sum(x * x for x in out[1]) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        vectors.Whitening([[1.0]], [1.0, 2.0])
    means = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],), (None,)], "c array<array<double>>").select(vectors.mean_of_chunks(F.col("c")).alias("m")).collect()
    assert [r["m"] for r in means] == [[2.0, 4.0], None]
    with pytest.raises(Exception, match="no chunk"):
        spark.createDataFrame([([],)], "c array<array<double>>").select(vectors.mean_of_chunks(F.col("c")).alias("m")).collect()
