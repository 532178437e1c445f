import pytest

from colophon.llm import truncation

DATA = "/root/testdata/sf0.01"
FREE = [
    "Nobody in the village remembered when the old mill had burned down", "She kept every letter in a tin box under the stairs", "The boats came home late because of the fog over the sea",
    "Most of the children could swim before they learned to read", "It rained for the best part of the week", "Their neighbours painted the gate a bright green",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.read.parquet(f"{DATA}/annotation_rows.parquet").select("mention_id", "workbook", "citation_content")
    whole = rows.where("citation_content rlike '[a-z]{3}[.]$'").orderBy("mention_id").limit(60).collect()
    extra = [(900000 + i, "free", t) for i, t in enumerate(FREE)] + [(910000 + i, "free", t) for i, t in enumerate([None, "", "  ", "N/A", "-", "."])]
    bare = [(920000 + i, r["workbook"], r["citation_content"][:-1]) for i, r in enumerate(whole)]
    # cut three signs into the last word but two
    cut = [(930000 + i, r["workbook"], " ".join(r["citation_content"].split(" ")[:-2]) + " " + r["citation_content"].split(" ")[-2][:3]) for i, r in enumerate(whole)]
    marks = [(940000, "free", "They compared both designs of the [...]"), (940001, "free", "They compared both designs, and"), (940002, "free", "They compared both (see Table 2 and")]
    more = spark.createDataFrame(extra + bare + cut + marks, rows.schema)
    out = truncation.truncated_values(rows.unionAll(more).unionAll(more), documents=spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert len({r["mention_id"] for r in out}) == len(out)
    return {r["mention_id"]: r["reason"] for r in out}


def test_finished_free_sentences_without_full_stop_and_blank_values_are_no_case(found):
    assert [FREE[i] for i in range(6) if 900000 + i in found] == []
    assert not any(i in found for i in range(910000, 910010))


def test_sentences_of_the_corpus_that_only_lack_their_full_stop_are_no_case(found):
    assert sum(i in found for i in range(920000, 920060)) <= 1


def test_values_cut_inside_a_word_are_found(found):
    assert sum(i in found for i in range(930000, 930060)) >= 55


def test_marks(found):
    assert found[940000] == "omission" and found[940001] == "sentence" and found[940002] == "open"


def test_trie_nodes(spark):
    items = spark.createDataFrame([("to", 5), ("ton", 2), ("a b", 3), ("a b c", 4)], "item string, n long")
    signs = {r["prefix"]: (r["n_below"], r["n_own"]) for r in truncation.trie_nodes(items).collect()}
    assert signs["t"] == (7, 0) and signs["to"] == (2, 5) and signs["ton"] == (0, 2)
    parts = {r["prefix"]: (r["n_below"], r["n_own"]) for r in truncation.trie_nodes(items, " ").collect()}
    assert parts["a"] == (7, 0) and parts["a b"] == (4, 3)
    assert truncation.truncated_values(spark.createDataFrame([], "mention_id long, workbook string, citation_content string")).count() == 0
