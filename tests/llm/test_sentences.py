import pytest

from colophon.llm.sentences import sentence_spans, sentence_units

CASES = [
    ("en", "Dr. Smith came at 2.30 p.m. in May. He left.", ["Dr. Smith came at 2.30 p.m. in May.", "He left."]),
    ("en", "See Jones et al. (2010) and Fig. 3. Then stop!", ["See Jones et al. (2010) and Fig. 3.", "Then stop!"]),
    ("en", "A heading\n\nThe text goes\non here. End.", ["A heading", "The text goes\non here.", "End."]),
    ("en", "Items:\n- one thing\n- two things", ["Items:", "- one thing", "- two things"]),
    ("en", "“One. Two.” Three.", ["“One.", "Two.”", "Three."]),
    ("en", "The quote “stop.” was odd. It was found in 2015. Next.", ["The quote “stop.” was odd.", "It was found in 2015.", "Next."]),
    ("en", "The U.S. model works. E. coli grows.", ["The U.S. model works.", "E. coli grows."]),
    ("de", "Am 3. Mai kam er, z. B. früh. Er ging.", ["Am 3. Mai kam er, z. B. früh.", "Er ging."]),
    ("fr", "Voir M. Dupont, p. 3. « Oui. » Fin.", None), ("ru", "Это рис. 3. Потом конец.", ["Это рис. 3.", "Потом конец."]),
    ("el", "Τι είναι; Είναι αυτό.", ["Τι είναι;", "Είναι αυτό."]), ("zh", "这是一。这是二！这是三？", ["这是一。", "这是二！", "这是三？"]),
    ("ja", "彼は「はい。」と言った。終わり。", ["彼は「はい。」と言った。", "終わり。"]), ("hi", "यह एक है। यह दो है।", ["यह एक है।", "यह दो है।"]),
    ("th", "นี่คือหนึ่ง นี่คือ 2 สอง", ["นี่คือหนึ่ง", "นี่คือ 2 สอง"]), ("ar", "ما هذا؟ هذا كتاب.", ["ما هذا؟", "هذا كتاب."]), ("", "no boundary", ["no boundary"]), (None, " \n ", []), ("en", None, []),
]


@pytest.mark.parametrize(("lang", "text", "wanted"), CASES)
def test_units(lang, text, wanted):
    spans = sentence_spans(text, lang)
    if wanted is not None:
        assert [text[a:b] for a, b in spans] == wanted
    if text:
        assert "".join(text[a:b] for a, b in spans).split() == "".join(text[a:b] for a, b in spans).split()
        covered = "".join(text[a:b] for a, b in spans)
        assert "".join(covered.split()) == "".join(text.split())


def test_rows(spark):
    docs = spark.createDataFrame([(1, "One. Two.", "en"), (2, None, "en"), (3, "", None), (4, "x" * 200_000, "en")], "doc_id long, text string, lang string")
    rows = sentence_units(docs).collect()
    assert [(r["doc_id"], r["sent_start"], r["sent_end"]) for r in rows if r["doc_id"] == 1] == [(1, 0, 4), (1, 5, 9)] and {r["doc_id"] for r in rows} == {1, 4}
    assert sentence_units(docs, sentence=False).columns == ["doc_id", "sent_no", "sent_start", "sent_end"]
