"""Problem 10: sentence boundaries across languages and scripts.

Method: ordered break and no-break pairs of regular expressions (what stands before a position,
what stands after it). The tables cascade: layout, then the language of the running fragment,
then its script, then the common table; the first pair that matches decides a position.

Defined cases: NULL, empty and blank texts have no units; a text without boundary is one unit.
Offsets count Unicode characters of the stored text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass

BREAK, JOIN = True, False
#: Letters with case of the Latin, Greek and Cyrillic scripts.
UPPER = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
LOWER = "".join(c for c in map(chr, range(0x61, 0x530)) if c.islower())
CLOSERS = "\"'”’»)\\]」』）】》“"
#: Characters of text that a pair may look at, before and after a position.
BEFORE, AFTER = 40, 30
#: Characters ahead that help to tell the language of a short fragment.
AHEAD = 60

# Words that show the language of a fragment in Latin script.
STOPWORDS = {
    "en": "the of and in to is was for that with by from are an on this which it as".split(),
    "de": "der die das und ist von mit zu den dem des im ein eine wurde bei nach für auf aus unter wir zum zur am gar".split(),
    "fr": "le la les des et est dans une du que pour sur par nous au avec selon qui entre reste".split(),
    "es": "el los las del una por con para que según entre nuestro fue al de y en tras su más".split(),
}
_STOP = {word: [lang for lang, words in STOPWORDS.items() if word in words] for words in STOPWORDS.values() for word in words}

# Abbreviations. "title": a name or number follows; "inner": never ends a sentence;
# "either": ends one when a capital letter follows.
ABBREVIATIONS = {
    "en": {
        "inner": "Dr Prof Mr Mrs Ms St Fig Figs No Nos Vol vol no nos Sect Sec Ch Eq Eqs Tab Ref Refs p pp cf vs viz "
        "e.g i.e approx ca c al.g Rev Gen Col Hon Assoc eds ed repr trans fig figs eq para paras n.d resp incl ext",
        "either": "etc Inc Ltd Co Jr Sr Corp al a.m p.m Univ Dept",
    },
    "de": {
        "inner": "Dr Prof Hr Fr Nr Abb Tab Bd S s Vgl vgl bzw z.B z B d.h d h u.a u a ca evtl ggf inkl Kap Hrsg Aufl Jg St "
        "sog v.a i.d.R Mio Mrd ff f o.g zzgl Anm Str Abs Art",
        "either": "usw etc al u.v.m",
    },
    "fr": {
        "inner": "M MM Mme Mlle Dr Pr no No nº fig Fig p pp cf p.ex ex env vol chap c.-à-d c.-à.-d art éd av apr tabl tab s ca",
        "either": "etc al",
    },
    "es": {
        "inner": "Sr Sra Srta Dr Dra Prof Profa D Dña p.ej ej pág págs fig Fig núm núms vol cap aprox cf Vd Ud Uds art ed tab n.º",
        "either": "etc al EE.UU",
    },
    "ru": {
        "inner": "рис табл см с стр т.е т е т.д.р проф акад д-р доц им гл ср напр т.н ул обл гг в вв тыс млн млрд разд №",
        "either": "др г т.д д т.п п пр",
    },
    "el": {"inner": "σχ δηλ κ κκ π.χ χ πίν σελ σ βλ πρβλ καθ δρ κος κα αρ τ εικ", "either": "κ.ά ά κ.λπ λπ κ.τ.λ"},
    "ar": {"inner": "د أ م ص ج ر", "either": ""},
    "hi": {"inner": "डॉ प्रो श्री सं पृ क्र", "either": ""},
}
#: Abbreviations that languages in Latin script share, so that a mistaken language does no harm.
LATIN_INNER = "Dr Prof Nr vol Vol fig Fig Abb pp cf vgl bzw approx vs"
# Words that begin a sentence, after abbreviations made of single capitals.
STARTERS = (
    "The A An In On At For This These Those That It We They He She Our However Moreover In As When While If After Before "
    "Because Such Similarly Table Figure Two Three No To Further Following Unlike With Taken What Is Are Costs"
).split()


def _words(text: str) -> str:
    return "|".join(re.escape(w).replace(r"\.", r"\.\s?") for w in sorted(set(text.split()), key=len, reverse=True))


def _pairs(*rows: tuple[bool, str, str]) -> list[tuple[bool, re.Pattern, re.Pattern]]:
    return [(d, re.compile(f"(?:{b})\\Z"), re.compile(a)) for d, b, a in rows]


def _language(lang: str) -> list[tuple[bool, re.Pattern, re.Pattern]]:
    """The table of a language: abbreviations first, then what is particular to it."""
    known = ABBREVIATIONS[lang]
    rows = []
    if lang in STOPWORDS:
        rows += [
            (JOIN, r"\bet al\.", rf"\s*[(\[,;]|\s+(?:19|20)\d\d\b|\s+[{LOWER}](?![{UPPER}])"),
            (JOIN, r"\b(?:No|Nos|no|nos|p|S)\.", r"\s+\d"),
            (JOIN, rf"(?<!\w)(?:{_words(LATIN_INNER)})\.", r"\s+\S"),
        ]
    if lang == "en":
        rows += [
            (BREAK, r"\b(?:[A-Z]\.){2,}", rf"\s+[“\"(]?(?:{'|'.join(STARTERS)})\b"),
            (JOIN, r"\b(?:[A-Z]\.){2,}", r"\s"),
            (BREAK, r"\b(?:no|No)\.", rf"\s+[{UPPER}]"),
        ]
    if lang == "de":
        months = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Okt|Dez"
        rows += [
            (JOIN, r"(?<![\d.,])\d{1,2}\.", rf"\s+(?:{months})\b"),
            (JOIN, r"\b(?:Am|am|Vom|vom|Zum|zum|Im|im|Die|die|Der|der|Das|das|Den|den|Dem|dem|Des|des|Seit|seit|Bis|bis|Ab|ab)\s+\d{1,3}\.", rf"\s+[{UPPER}]"),
        ]
    if lang == "ru":
        rows += [(BREAK, r"\d\s?гг?\.", rf"\s+[«„“]?[{UPPER}]"), (JOIN, r"(?<!\d)\s(?:г|д|п)\.", r"\s")]
    if known["either"]:
        rows += [
            (BREAK, rf"(?<!\w)(?:{_words(known['either'])})\.", rf"\s+(?:[“”„«\"'‘(¿¡]\s?)?[{LOWER}]?[{UPPER}]|\s+\d|\s*\Z|\s*\n\s*\n"),
            (JOIN, rf"(?<!\w)(?:{_words(known['either'])})\.", r""),
        ]
    rows += [(JOIN, rf"(?<!\w)(?:{_words(known['inner'])})\.", r"\s*[^\s]")]
    return _pairs(*rows)


LANGUAGE_TABLES = {lang: _language(lang) for lang in ABBREVIATIONS}

SCRIPT_TABLES = {
    # no spaces: a closing mark right after the sign, with text right after it, is a quotation within the sentence
    "wide": _pairs(
        (JOIN, rf"[。！？!?…][{CLOSERS}]+", r"[^\s\n“「『]"),
        (BREAK, rf"[。！？…][{CLOSERS}]*", r""),
        (BREAK, rf"[.!?][{CLOSERS}]*", r"\s*[\u3040-\u9fff\uac00-\ud7af]"),
    ),
    "uncased": _pairs(
        (JOIN, rf"[.!?؟।॥][{CLOSERS}]+", r"[ \t]+[^\sA-Z“«\"(]"),
        (BREAK, rf"[!?؟।॥۔][{CLOSERS}]*", r"\s|\Z"),
        (BREAK, rf"\.[{CLOSERS}]*", r"\s+\S"),
    ),
    "greek": _pairs((BREAK, rf";[{CLOSERS}]*", r"\s|\Z")),
}

COMMON_TABLE = _pairs(
    (JOIN, r"[;]", r""),
    (JOIN, rf"(?<![^\W_])[{UPPER}]\.", r"\s+[^\W\d_]"),  # initials
    (JOIN, r"(?:^|\n)[ \t]*\(?\d{1,3}(?:\.\d{1,3})*\.", r"[ \t]"),  # number at the head of a line
    (JOIN, rf"[.!?…](?:[{CLOSERS}]|\s»)*", rf"\s+[{LOWER}](?![{UPPER}])"),
    (BREAK, rf"(?:[{LOWER}]{{2}}|\d[)\]]|\d{{4}}|[{LOWER}”])[.!?]”?", rf"[{UPPER}][{LOWER}’]"),  # missing space
    (BREAK, rf"[.!?。！？؟।…][{CLOSERS}]*", r"[\u0e00-\u0e7f\u3040-\u9fff\uac00-\ud7af]"),
    (BREAK, rf"[.!?。！？؟।॥…]+(?:[{CLOSERS}]|\s»)*", r"\s|\Z"),
    (BREAK, r"[。！？]", r""),
)

_CANDIDATE = re.compile(
    rf"(?P<stop>[.!?。！？؟।॥۔…;]+(?:[{CLOSERS}]|[ \u00a0\u202f]»)*)"
    r"|(?P<layout>\n[ \t\r]*\n\s*|\n(?=[ \t]*(?:[-•*·▪◦‣]|\(?\d{1,3}[.)]|[a-z]\))[ \t]+\S))"
    r"|(?P<thai>(?<=[\u0e00-\u0e7f])[ \u00a0]+(?=\S))"
)
_NUMBERED = re.compile(r"[ \t]*(?:\(?\d{1,3}[.)]|[a-z]\))[ \t]")
_THAI_SIDE = re.compile(r"[\d(\[%]")
_WORDS = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


# Letter ranges of the scripts that have tables.
SCRIPT_RANGES = (
    ("greek", "\u0370", "\u03ff"), ("greek", "\u1f00", "\u1fff"), ("cyrillic", "\u0400", "\u052f"),
    ("arabic", "\u0590", "\u08ff"), ("indic", "\u0900", "\u0dff"), ("thai", "\u0e00", "\u0e7f"),
    ("wide", "\u3040", "\u9fff"), ("wide", "\uac00", "\ud7af"),
)


def _script(fragment: str) -> str:
    """Script of the last letter of a fragment."""
    for m in _LETTER.finditer(fragment[::-1]):
        ch = m.group()
        if ch < "\u0250":
            return "latin"
        for name, low, high in SCRIPT_RANGES:
            if low <= ch <= high:
                return name
        return "latin"
    return "latin"


def _latin_language(fragment: str, fallback: str) -> str:
    votes = {fallback: 0.5} if fallback in STOPWORDS else {"en": 0.5}
    for word in _WORDS.findall(fragment.lower()):
        for lang in _STOP.get(word, ()):
            votes[lang] = votes.get(lang, 0) + 1
    return max(votes, key=votes.get)


def _tables(fragment: str, ahead: str, lang: str) -> list:
    script = _script(fragment)
    if script == "latin":
        return [LANGUAGE_TABLES[_latin_language(fragment + ahead, lang)]]
    if script == "greek":
        return [LANGUAGE_TABLES["el"], SCRIPT_TABLES["greek"]]
    if script == "cyrillic":
        return [LANGUAGE_TABLES["ru"]]
    if script == "arabic":
        return [LANGUAGE_TABLES["ar"], SCRIPT_TABLES["uncased"]]
    if script == "indic":
        return [LANGUAGE_TABLES["hi"], SCRIPT_TABLES["uncased"]]
    if script == "wide":
        return [SCRIPT_TABLES["wide"]]
    return []


#: The plain cases, told by the signs around a stop before any table is read; every table comes to the same.
#: A break: after a word of lower-case Latin letters that is no abbreviation of any language, or after a bracket, before
#: white space and a capital. No break: a full stop with a digit, a small letter or a mark right behind it, 'et al.' before a bracket, and a semicolon in Latin text.
_SHORT = frozenset(w.split(".")[-1].lower() for known in ABBREVIATIONS.values() for group in known.values() for w in group.split()) | frozenset(LATIN_INNER.lower().split())
_PLAIN_BEFORE = re.compile(r"(?:(?<![^\W\d_])([A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]{2,})|[\d%][)\]]|(?<=[a-z] )\d{4})[.!?]\Z")
_PLAIN_AFTER = re.compile(r"\s+[A-ZÀ-ÖØ-Þ]")
_INSIDE = frozenset("0123456789abcdefghijklmnopqrstuvwxyz,;:")


def _plain(text: str, start: int, position: int, sign: str) -> bool | None:
    """The decision of a plain case; None where the tables decide."""
    if sign == "." and text[position] in _INSIDE:
        return JOIN
    if sign == ";" and "a" <= text[position - 2 : position - 1].lower() <= "z":
        return JOIN
    if sign == "." and text[position : position + 2] in (" (", " [") and text[max(start, position - 6) : position] == "et al.":
        return JOIN
    m = _PLAIN_BEFORE.search(text, max(start, position - 24), position)
    if m and (m.group(1) is None or m.group(1).lower() not in _SHORT) and _PLAIN_AFTER.match(text, position):
        return BREAK
    return None


def _decide(text: str, position: int, fragment: str, lang: str) -> bool:
    before, after = text[max(0, position - BEFORE) : position], text[position : position + AFTER]
    for tab in (*_tables(fragment, text[position : position + AHEAD], lang), COMMON_TABLE):
        for decision, left, right in tab:
            if right.match(after) and left.search(before):
                return decision
    return JOIN


def _numbered_line(text: str, line_break: int) -> bool:
    """A numbered line is a list line if the line before ended or is numbered itself."""
    previous = text[text.rfind("\n", 0, line_break) + 1 : line_break].rstrip()
    return not previous or previous[-1] in ".!?:;。！？؟।”»" or bool(_NUMBERED.match(previous + " "))


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, outer white space left out."""
    if not text or text.isspace():
        return []
    lang = (lang or "").strip().lower()[:2]
    cuts, start = [], 0
    for m in _CANDIDATE.finditer(text):
        if m.lastgroup == "layout":
            line = text[m.end() : m.end() + 8]
            cut = m.group().count("\n") > 1 or not _NUMBERED.match(line) or _numbered_line(text, m.start())
        elif m.lastgroup == "thai":
            cut = not (_THAI_SIDE.match(text[m.start() - 1]) or _THAI_SIDE.match(text[m.end()]))
        else:
            cut = m.end() < len(text) and _plain(text, start, m.end(), m.group())
            if cut is None:
                cut = _decide(text, m.end(), text[start : m.end()], lang)
        if cut:
            cuts.append(m.end())
            start = m.end()
    spans, start = [], 0
    for cut in (*cuts, len(text)):
        piece = text[start:cut]
        left = len(piece) - len(piece.lstrip())
        if left < len(piece):
            spans.append((start + left, start + len(piece.rstrip())))
        start = cut
    return spans


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", sentence: bool = True) -> DataFrame:
    """One row per sentence unit: key, sent_no, sent_start, sent_end and, unless it isn't wanted, sentence. A narrow pass without shuffle."""
    source = documents.where(F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
        (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"),
    )

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            for n, (a, b) in enumerate(sentence_spans(r["text"], r["lang"])):
                yield (r["key"], n, a, b, r["text"][a:b]) if sentence else (r["key"], n, a, b)

    schema = "key long, sent_no int, sent_start long, sent_end long"
    out = arrow_pass(source, rows, schema + ", sentence string" if sentence else schema)
    return out.withColumnRenamed("key", key)
