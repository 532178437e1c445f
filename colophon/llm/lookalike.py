"""Problem 6: text that looks the same but differs in its characters.

Method: normalization quick-check properties isolate the unstable segments of a value; only
those segments are normalised, together with their boundary context (the whole word and its
neighbour words), and the canonical segments are spliced into the text that was left alone.

The properties are taken from the Unicode database: NFC_QC is No for a sign that NFC changes and Maybe for a second
part of a composition; NFKC counts for signs whose compatibility form is the same letters, digits or spaces in
another width, font, joining or contextual form. Besides these, signs that don't show, special spaces and hyphens, and
letters of scripts that have look-alikes of Latin ones are looked at.

Defined cases: NULL stays NULL and empty text stays empty; both count as unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass

# Look-alike letters, foreign letter to the Latin letter it imitates.
CYRILLIC_AS_LATIN = dict(
    zip("АВЕЅІЈКМНОРСТУХЬаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTYXbaesijopcyxhdqwv", strict=True)
)
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοριϲϳ", "ABEZHIKMNOPTYXavopicj", strict=True))
AS_LATIN = CYRILLIC_AS_LATIN | GREEK_AS_LATIN
LATIN_AS_CYRILLIC = {v: k for k, v in CYRILLIC_AS_LATIN.items() if k != "Ь"}

# Code points that don't show, joiners, special spaces, special hyphens.
INVISIBLE = "­͏؜ᅟᅠ᠎​‎‏‪-‮⁠-⁩﻿"
JOINERS = "‌‍"
SPACES = "   -   　"
HYPHENS = "‐‑﹣"

# Look-alikes of Latin letters in scripts whose other letters look unlike them.
OTHER_AS_LATIN = dict(
    zip(
        "ոսօհյցզքԼՕՏ" + "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏢᏦᏟᏞᎥᏏ" + "ⲞⲟⲢⲣⲤⲥⲬⲭⲔⲘⲚⲎⲦⲂ" + "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" + "ɡɑᴄᴏᴠᴡᴢ",
        "nuohjgqpLOS" + "DRTAJEWMHGZSVPKCLib" + "OoPpCcXxKMNHTB" + "BPDTGKJCZFMNLSRVHWXYAEIOU" + "gacovwz", strict=True,
    )
)
AS_LATIN |= OTHER_AS_LATIN
#: Compatibility forms that look like the letters, digits or spaces they stand for.
LIKE = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>", "<compat>")
#: Signs of their own that have such a form: letter-like symbols, the micro sign, the long s, enclosed and squared signs, radicals.
SYMBOLS = re.compile("[\u00b5\u017f\u0675-\u0678\u0e33\u0eb3\u1e9a\u1e9b\u2100-\u214f\u2180-\u218b\u2460-\u24ff\u3130-\u318f\u3200-\u33ff\U0001f100-\U0001f2ff]")


def composition_seconds() -> set[str]:
    """Signs that compose with one before them (NFC_QC=Maybe)."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0xC0, 0x1_2000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.is_normalized("NFC", c):
            out.add(chr(int(parts[1], 16)))
    return out


def compatible(ch: str) -> bool:
    """Whether a sign only differs in width, font, joining or form from the letters, digits, marks or spaces it stands for."""
    kind = unicodedata.decomposition(ch).split(" ", 1)[0]
    if kind not in LIKE or SYMBOLS.match(ch):
        return False
    plain = unicodedata.normalize("NFKC", ch)
    return kind in ("<wide>", "<narrow>", "<noBreak>") or all(c.isalnum() or unicodedata.category(c)[0] == "M" for c in plain)


def unstable_signs() -> set[str]:
    """All signs at which a value is looked at, by the properties and the lists above."""
    signs = composition_seconds() | set(AS_LATIN) | set(JOINERS + HYPHENS)
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x1_2000), *range(0x1_D400, 0x1_F300), *range(0x2_F800, 0x2_FA20))):
        if not unicodedata.is_normalized("NFC", c) or compatible(c):
            signs.add(c)
    return signs


def as_class(signs: set[str]) -> str:
    """Ranges of a character class."""
    codes, out = sorted(map(ord, signs)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: Greek and Cyrillic as a whole: a word of one of them with a Latin letter inside is unstable, too.
UNSTABLE_CLASS = INVISIBLE + SPACES + "Ͱ-ϿЀ-ԯ" + as_class(unstable_signs())
_UNSTABLE = re.compile(f"[{UNSTABLE_CLASS}]")
_DELETE = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_WORD = re.compile(r"[^\W\d_]+")
_JOINED_SCRIPTS = ("ARABIC", "SYRIAC", "DEVANAGARI", "BENGALI", "GUJARATI", "GURMUKHI", "KANNADA", "MALAYALAM",
                   "ORIYA", "SINHALA", "TAMIL", "TELUGU", "MONGOLIAN", "KHMER", "MYANMAR", "TIBETAN")


@lru_cache(maxsize=4096)
def script_of(ch: str) -> str:
    """First word of the character's name: its script, for letters."""
    return unicodedata.name(ch, "").split(" ", 1)[0]


def _wide(ch: str) -> bool:
    """East Asian text, beside which full-width punctuation is ordinary."""
    return bool(ch) and (
        "\u2e80" <= ch <= "\u9fff" and ch != "\u3000" or "\uac00" <= ch <= "\ud7ff" or ch >= "\U00020000"
    )


def _narrow_width(text: str, i: int) -> str:
    """Full- and half-width forms: letters and digits always, punctuation only outside East Asian text."""
    ch = text[i]
    plain = unicodedata.normalize("NFKC", ch)
    if plain.isalnum() or not "\uff01" <= ch <= "\uff5e":
        return plain
    for step in (-1, 1):
        k = i + step
        while 0 <= k < len(text) and (text[k].isspace() or "\uff01" <= text[k] <= "\uff5e" and not unicodedata.normalize("NFKC", text[k]).isalnum() or text[k] in "“”‘’"):
            k += step
        if 0 <= k < len(text) and _wide(text[k]):
            return ch
    return plain


def _keeps_joiner(text: str, i: int) -> bool:
    """A joiner is ordinary between letters of a script that joins, and in emoji sequences."""
    around = [text[k] for k in (i - 1, i + 1) if 0 <= k < len(text)]
    if len(around) < 2:
        return False
    return all(script_of(c) in _JOINED_SCRIPTS for c in around) or all(unicodedata.category(c) in ("So", "Sk", "Mn") for c in around)


def _characters(text: str, start: int, end: int) -> str:
    """Character level of a segment: width, joined letters, invisible signs, spaces and hyphens."""
    out = []
    for i in range(start, end):
        ch = text[i]
        if ch < "\u0080" or not _UNSTABLE.match(ch):
            out.append(ch)
        elif _DELETE.match(ch):
            continue
        elif ch in JOINERS:
            if _keeps_joiner(text, i):
                out.append(ch)
        elif _SPACE.match(ch):
            around = [text[k] for k in (i - 1, i + 1) if 0 <= k < len(text)]
            out.append(ch if ch == "\u3000" and len(around) == 2 and all(_wide(c) or c in "。！？，；：" for c in around) else " ")
        elif ch in HYPHENS:
            out.append("-")
        elif "\uff01" <= ch <= "\uffef":
            out.append(_narrow_width(text, i))
        elif compatible(ch):
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def _kinds(word: str) -> tuple[int, int, int]:
    """Latin letters, foreign look-alikes and other foreign letters of a word."""
    latin = alike = other = 0
    for ch in word:
        if ch in AS_LATIN:
            alike += 1
        elif ch < "ɐ" or script_of(ch) == "LATIN":
            latin += 1
        else:
            other += 1
    return latin, alike, other


def _letters(segment: str, before: str, after: str) -> str:
    """Word level of a segment: letters of another script in place of like ones.

    ``before`` and ``after`` are the neighbour words of the segment; they decide for words
    that consist of look-alikes only.
    """
    words = list(_WORD.finditer(segment))
    if not words:
        return segment
    out, done = [], 0
    for n, m in enumerate(words):
        word = m.group()
        latin, alike, other = _kinds(word)
        new = word
        if latin and alike and not other and (len(word) > 2 or any(c in CYRILLIC_AS_LATIN for c in word)):
            new = "".join(AS_LATIN.get(c, c) for c in word)
        elif latin and other >= 2 and all(script_of(c) == "CYRILLIC" or c in LATIN_AS_CYRILLIC for c in word):
            new = "".join(LATIN_AS_CYRILLIC.get(c, c) for c in word)
        elif alike and not latin and not other and (len(word) > 1 or word in CYRILLIC_AS_LATIN):
            sides = [words[n - 1].group() if n else before, words[n + 1].group() if n + 1 < len(words) else after]
            counts = [_kinds(s) for s in sides if s]
            if not any(o for _, _, o in counts) and any(c[0] for c in counts):
                new = "".join(AS_LATIN[c] for c in word)
        out += [segment[done : m.start()], new]
        done = m.end()
    return "".join(out) + segment[done:]


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; unstable segments only, the rest is spliced in as it is."""
    if not text or text.isascii():
        return text
    out, done, n = [], 0, len(text)
    for m in _UNSTABLE.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < n and (not text[end].isspace() or _SPACE.match(text[end])):
            end += 1
        before = _WORD.findall(text[max(0, start - 60) : start])
        after = _WORD.findall(text[end : end + 60])
        segment = _characters(text, start, end)
        out += [text[done:start], _letters(segment, before[-1] if before else "", after[0] if after else "")]
        done = end
    return "".join(out) + text[done:]


def unstable(column: Column) -> Column:
    """JVM test that keeps most values out of Python: whether a value has more than ASCII signs. NULL counts as stable."""
    return F.coalesce(F.octet_length(column) != F.length(column), F.lit(False))


def canonical_values(df: DataFrame, key: str, fields: list[str], leave: dict[str, Callable[[str], bool]] | None = None) -> DataFrame:
    """Changed values only: (key, field_name, original, canonical), one row per key, field and value.

    Values of ASCII signs never leave the JVM; repeated rows give repeated output. ``leave`` has a test per field for
    changed values that are left out.
    """
    cells = None
    for field in fields:
        part = df.where(unstable(F.col(field))).select(
            F.col(key).cast("long").alias("key"), F.lit(field).alias("field_name"), F.col(field).alias("original")
        )
        cells = part if cells is None else cells.unionAll(part)
    tests = leave or {}

    def rows(batch):
        for r in batch:
            field, old = r["field_name"], r["original"]
            new = canonical(old)
            if new != old and not (field in tests and tests[field](old)):
                yield r["key"], field, old, new

    return arrow_pass(cells, rows, "key long, field_name string, original string, canonical string")


def with_canonical(df: DataFrame, field: str, to: str) -> DataFrame:
    """All rows with the canonical form of ``field`` in ``to``; stable values are passed as NULL to Python."""
    source = F.col(field)
    return df.withColumn(to, F.coalesce(F.udf(canonical, "string", useArrow=True)(F.when(unstable(source), source)), source))
