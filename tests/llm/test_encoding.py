import pytest

from colophon.llm import encoding
from colophon.llm.encoding import Repairer

CHINESE = "本文研究了土壤湿度的测定方法，并与已有的结果进行了比较。这种方法适用于大面积的观测。图中给出了各站点的数据。"
DATA = "/root/testdata/sf0.01"
PHRASES = {
    "ru": ("Методы измерения влажности почвы были описаны", ["cp1251", "koi8-r", "utf-8"]), "el": ("μέθοδος μέτρησης", ["cp1253", "utf-8"]),
    "zh": ("方法的比较研究", ["gb18030", "big5", "utf-8"]), "ja": ("土壌水分の測定方法", ["euc_jp", "utf-8"]), "th": ("การวัดความชื้นของดิน", ["cp874", "utf-8"]),
    "ar": ("قياس رطوبة التربة في الحقول", ["cp1256", "utf-8"]),
}


def read(raw: bytes, page: str) -> str:
    """Bytes read in a page; bytes without a sign there become controls, as in browsers."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def repairer(spark):
    return Repairer(encoding.language_samples(spark.read.parquet(f"{DATA}/documents.parquet")))


def test_whole_east_asian_phrase_read_as_gbk_is_restored():
    repairer = Repairer({"zh": CHINESE})
    for phrase in ("方法", "土壤湿度"):
        text = f"As shown by {phrase.encode().decode('gbk')} in the study"
        assert repairer.repair(text) == (True, f"As shown by {phrase} in the study", "gbk", True)


def test_correct_east_asian_text_is_left_alone():
    repairer = Repairer({"zh": CHINESE})
    for text in (CHINESE, "土壤湿度", "关于方法的研究 in the study", "土壌水分の測定方法", "图2显示，牛群密度"):
        assert repairer.repair(text) == (False, text, "", True)


def test_phrases_of_other_encodings_are_restored_or_left_but_never_made_worse(repairer):
    restored = wrong = total = 0
    for phrase, codecs in PHRASES.values():
        for codec in codecs:
            try:
                raw = phrase.encode(codec)
            except UnicodeEncodeError:
                continue
            for page in ("latin-1", "cp1252", "cp1251", "koi8-r"):
                if page == codec:
                    continue
                garbled, whole = (f"The handbook {x} lists wind loading as moderate." for x in (read(raw, page), phrase))
                got = repairer.repair(garbled)[1]
                total += 1
                restored += got == whole
                wrong += got not in (garbled, whole)
    assert wrong == 0 and restored >= 0.85 * total


def test_correct_texts_of_all_languages_are_left_alone(spark, repairer):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").where("text is not null").collect()]
    assert [t for t in texts if repairer.repair(t)[2]] == []
    for text in ("«Основы оценки»", "“ÎNCĂ O DATĂ” and « tâche »", "At 12 °C ± 3 µm", "naïve café, Łódź, Şişli", "e\u0301te\u0301"):
        assert repairer.repair(text)[2] == ""


def test_null_and_empty():
    repairer = Repairer({})
    assert repairer.repair(None) == (False, None, "", True) and repairer.repair("") == (False, "", "", True)
    assert repairer.repair("lost \ufffd sign")[0] and not repairer.repair("lost \ufffd sign")[3]


def test_double_decoding_is_undone(repairer):
    text = "The guide “区域统计（试行）：方法” treats gait, wrote Pérolvez"
    assert repairer.repair(read(read(text.encode(), "cp1252").encode(), "cp1252"))[1] == text
