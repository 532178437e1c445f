import unicodedata

import pytest
from pyspark.sql import functions as F

from colophon.llm.lookalike import _UNSTABLE, canonical, canonical_values, compatible, with_canonical

CHANGED = [
    ("Ｗｉｄｅ １２ text", "Wide 12 text"), ("été", "été"), ("ﬁne eﬃcient ĳs", "fine efficient ijs"), ("zero​width so­ft", "zerowidth soft"), ("a b c", "a b c"),
    ("non‑breaking", "non-breaking"), ("ѕсеnаrіо", "scenario"), ("Αthens Βerlin", "Athens Berlin"), ("𝐛𝐨𝐥𝐝 text", "bold text"), ("Ꮯity", "City"), ("maյor", "major"), ("Table Ⅷ", "Table VIII"),
    ("Ångstrom", "Ångstrom"), ("мeтoды", "методы"), ("ɡreen ɑnd", "green and"),
]
KEPT = ["", "plain", "été naïve Łódź", "x² ½ m³", "“quotes” – dashes … ™ ® №", "методы оценки", "μέθοδος", "Հայերեն", "ᏣᎳᎩ", "方法，步骤（一）。", "µm Ω-test ℃", "قياس", "ไทยคำ", "हिन्दी क्षेत्र", "한국어", "👩‍🔬"]


@pytest.mark.parametrize(("text", "wanted"), CHANGED)
def test_imitations_come_into_one_form(text, wanted):
    assert canonical(text) == wanted and canonical(wanted) == wanted


@pytest.mark.parametrize("text", KEPT)
def test_ordinary_text_stays(text):
    assert canonical(text) == text


def test_null():
    assert canonical(None) is None


def test_quick_check_properties():
    # every sign that NFC changes, and every second part of a composition, is unstable
    for code in (*range(0x80, 0xD800), *range(0xE000, 0xFFFE)):
        ch = chr(code)
        if not unicodedata.is_normalized("NFC", ch):
            assert _UNSTABLE.match(ch), hex(code)
    for mark in "゙̧̨̀́̈ᅡᆨா":
        assert _UNSTABLE.match(mark)
    assert compatible("Ａ") and compatible("ﬁ") and not compatible("²") and not compatible("½") and not compatible("…")


def test_the_rest_of_a_value_is_spliced_in_unchanged():
    text = "Long ordinary part — with signs… " * 20 + "ﬁn " + "and more ordinary ümläuts " * 20
    assert canonical(text) == text.replace("ﬁ", "fi")


def test_values_and_columns(spark):
    df = spark.createDataFrame([(1, "ﬁne", None), (1, "ﬁne", None), (2, "fine", "ｗｉｄｅ"), (3, None, ""), (4, "x�ﬁ", "a")], "k long, a string, b string")
    out = canonical_values(df, "k", ["a", "b"], {"a": lambda t: "�" in t}).collect()
    assert sorted((r["key"], r["field_name"], r["canonical"]) for r in out) == [(1, "a", "fine"), (1, "a", "fine"), (2, "b", "wide")]
    got = with_canonical(df, "a", "c").select("k", F.col("c")).distinct().collect()
    assert {(r["k"], r["c"]) for r in got} == {(1, "fine"), (2, "fine"), (3, None), (4, "x�fi")}
    assert canonical_values(df.limit(0), "k", ["a"]).count() == 0
