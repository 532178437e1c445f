"""Problem 4: text decoded with the wrong character encoding.

Method: every candidate chain of re-decodings is compressed with per-language zstandard
dictionaries; the chain with the minimum description length, its own cost included, is taken,
and the text is left unchanged where no chain is shorter.

Candidates are all pairs of a code page that a text was read in and the encoding it was written in: UTF-8 read in a
single-byte page or in GBK, and texts in Cyrillic, Greek, Thai, Arabic, Japanese, Chinese or Korean encodings read in a
single-byte page. Pages of Latin script read in one another differ in single letters of a word and are no candidates.
A candidate replaces only the parts whose characters are bytes of the other encoding, so text that is garbled in part
is restored in part. Signs of a decoding that lost
bytes (the replacement character, control characters of the C1 range, private-use characters)
mark a value as garbled even where nothing can be restored.

Defined cases: NULL and empty text are never garbled; repeated rows give repeated output.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass

#: Code pages that a UTF-8 text is often read with. cp1252 also takes the C1 controls that Latin-1 leaves.
SINGLE_BYTE = ("cp1252", "mac_roman", "cp1251", "cp850", "cp437", "iso8859-2", "koi8-r")
#: Other encodings of a text that was read in a single-byte page, with the scripts (first words of character names) they are written for.
WRITTEN = {
    "cp1251": ("CYRILLIC",), "koi8-r": ("CYRILLIC",), "cp866": ("CYRILLIC",), "cp1253": ("GREEK",), "cp874": ("THAI",), "cp1256": ("ARABIC",),
    "shift_jis": ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC"), "euc_jp": ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC"),
    "gb18030": ("CJK", "IDEOGRAPHIC"), "big5": ("CJK", "IDEOGRAPHIC"), "euc_kr": ("HANGUL",),
}
#: Encodings in which a second byte may be an ASCII sign, and those with two bytes a character.
MIXED, WIDE = ("shift_jis", "big5", "gb18030"), ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
#: Code pages that such a text is read in.
READ = ("cp1252", "cp1251", "koi8-r", "mac_roman", "cp850", "cp1250", "iso8859-2")
#: Bytes of a part that such a candidate must have, its cost, and the share of the description that it must save: any
#: bytes are text in these encodings, so a small gain proves nothing.
LEGACY_BYTES, LEGACY_COST, LEGACY_SHARE = 5, 2.0, 0.12
DOUBLE_BYTE = ("gbk",)
#: Description length of one more decoding step, in bytes, and of each raw byte beside its compressed size:
#: compressed sizes are whole bytes, so that a change of one sign would often be lost.
STEP_COST, RAW_BYTE_COST = 0.25, 0.25
MAX_STEPS = 3
#: Characters of context around the changed part.
WINDOW = 12
#: Bound of the dictionary sample: texts and characters per language.
DICTIONARY_TEXTS, DICTIONARY_CHARS = 48, 40_000
LANGUAGES = ("en", "de", "fr", "es", "ru", "el", "zh", "ja", "th", "ar", "hi")
# Correct text that the dictionaries should know besides their samples.
SEED_TEXT = "“”‘’–—…€£§°±²³½¼¾µμ×÷≥≤≠≈→•·αβγδλπσΩéèêëàâäáãåæçñöóòôøõüúùûîïíìßÉÀÄÅÇÑÖØÜŁłŠšŽžŻżĂăÎîȘșȚț«»¿¡™®© "

#: Neighbouring signs of single-byte pages, as in text of another script read in one.
_HIGH_RUN = re.compile("[\u0080-\u052f\u2010-\u20ff\u2100-\u25ff]{3}")
_LOST = re.compile("[\ufffd\u0080-\u009f\ue000-\uf8ff]")
_HAN_RUN = re.compile("[\u2460-\u24ff\u2500-\u25ff\u2605\u2606\u2e80-\u9fff\uac00-\ud7af\ue000-\uf8ff\uff01-\uffef\u2103\u2109\u2116\u2160-\u217f]+")


#: Letters that hardly any text has but that two chance bytes often give: phonetic and modifier letters, rare Latin ones.
_RARE = re.compile("[\u0180-\u0191\u0193-\u01cc\u01dd-\u0217\u021c-\u02c5\u02c7-\u02db\u02dd-\u02ff\u0305\u030d-\u031a\u031c-\u0322\u0324-\u0326\u0329-\u037f\u0460-\u0489\u048a-\u052f\u07c0-\u07ff]")


def _plausible(text: str, start: int, end: int, new: str) -> bool:
    """Whether decoded signs may stand where they do: assigned, not rare, and of the script of the letters beside them.

    Inside a word of Latin letters only such letters (or Greek ones) fit; a combining mark needs a letter before it.
    """
    if _RARE.search(new) or any(unicodedata.category(c) in ("Cn", "Cs", "Co") or c < "\u0080" and c.isascii() and not c.isprintable() for c in new):
        return False
    left = text[start - 1 : start]
    if unicodedata.category(new[0]) == "Mn" and not (left.isascii() and left.isalpha()):
        return False
    # one letter of a script whose letters stand together, or a control sign of lost bytes beside the part, is chance
    if len(new) == 1 and ("\u0530" <= new <= "\u0e7f" or script(new) == "HANGUL" or _CONTROL.match(left) or _CONTROL.match(text[end : end + 1])):
        return False
    for side, ch in ((text[start - 1 : start], new[0]), (text[end : end + 1], new[-1])):
        if side.isalpha() and unicodedata.category(ch)[0] in "LM" and script(ch) not in ("COMBINING", "ANGSTROM", "KELVIN", "MICRO"):
            fits = ("LATIN", "GREEK", "MICRO") if side.isascii() else (script(side), *EAST_ASIAN) if script(side) in EAST_ASIAN else (script(side),)
            if script(ch) not in fits:
                return False
    return True


_CONTROL = re.compile("[\u0080-\u009f]")
EAST_ASIAN = ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "IDEOGRAPHIC")


def script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ", 1)[0]


class CodePage:
    """How UTF-8 bytes look when they are read in a single-byte code page."""

    def __init__(self, name: str):
        self.name, self.byte_of = name, {}
        chars = {}
        for b in range(0x80, 0x100):
            try:
                ch = bytes([b]).decode(name)
            except UnicodeDecodeError:
                ch = chr(b)
            chars[b] = {ch}
            if name == "cp1252" and b < 0xA0:
                chars[b].add(chr(b))
            for c in chars[b]:
                self.byte_of[c] = b
        group = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi) for c in chars[b]) + "]"
        tail = group(0x80, 0xC0)
        self.shape = re.compile(
            f"(?:{group(0xC2, 0xE0)}{tail}|{group(0xE0, 0xF0)}{tail}{{2}}|{group(0xF0, 0xF5)}{tail}{{3}})+"
        )
        high = group(0x80, 0x100)
        # words of high bytes only; and for two-byte encodings what stands between white space
        self.words = re.compile(f"{high}+(?:[ ,.:;-]{{1,2}}{high}+)*")
        self.tokens = re.compile(f"{high}(?:{high}|[\x40-\x7e])*")
        self.high = re.compile(high)

    def decode(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with every part that spells UTF-8 decoded, and these parts."""
        parts = []

        def put(m):
            raw = bytes(self.byte_of[c] for c in m.group())
            try:
                new = raw.decode("utf-8")
            except UnicodeDecodeError:
                return m.group()
            # a letter of the page beside the part was no UTF-8, so the part is hardly any
            beside = (text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])
            if any(c.isalpha() and c in self.byte_of for c in beside) or not _plausible(text, m.start(), m.end(), new):
                return m.group()
            parts.append((m.start(), m.end(), new))
            return new

        return self.shape.sub(put, text), parts


#: Quotes and dashes around a part that are no bytes of it.
_QUOTES = "“”‘’«»–—… ,.:;-"


def _written(new: str, scripts: tuple[str, ...]) -> bool:
    """Whether a decoded part reads like text of one of the scripts: no other letters, no signs of no use, capitals only where words begin."""
    letters = 0
    for i, ch in enumerate(new):
        kind = unicodedata.category(ch)
        if kind[0] in "LM":
            if script(ch) not in scripts and not (ch.isascii() and len(scripts) > 1):
                return False
            if kind == "Lu" and i and unicodedata.category(new[i - 1]) == "Ll":
                return False
            letters += not ch.isascii()
        elif not (ch in " ,.:;-()、。「」・ー，：；（）" or kind in ("Nd", "Po", "Ps", "Pe")):
            return False
    return letters >= 2 and 2 * letters >= len(new) - new.count(" ")


def decode_written(text: str, page: CodePage, codec: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every part that was read in ``page`` but reads well in ``codec`` decoded, and these parts."""
    parts, out, done = [], [], 0
    for m in (page.tokens if codec in MIXED else page.words).finditer(text):
        part = m.group()
        start = m.start()
        outer = _QUOTES[:6] if codec in MIXED else _QUOTES
        start += len(part) - len(part.lstrip(outer))
        part = part.strip(outer)
        if len(part) < LEGACY_BYTES or len(page.high.findall(part)) < (LEGACY_BYTES + 1) // 2:
            continue
        try:
            new = bytes(page.byte_of.get(c, ord(c) & 0xFF) for c in part).decode(codec)
        except UnicodeDecodeError:
            continue
        if not _written(new, WRITTEN[codec]) or any(_written(part, (own,)) and WRITTEN[codec] != (own,) for own in ("CYRILLIC", "GREEK")):
            continue
        parts.append((start, start + len(part), new))
        out += [text[done:start], new]
        done = start + len(part)
    return "".join(out) + text[done:], parts


def _utf8_prefix(raw: bytes) -> tuple[str, bool]:
    """Decoded text of bytes that may end inside a character, and whether they are such UTF-8."""
    for cut in range(min(4, len(raw) + 1)):
        try:
            text = raw[: len(raw) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
        rest = raw[len(raw) - cut :]
        if not rest or rest[0] >= 0xC2 and all(0x80 <= b < 0xC0 for b in rest[1:]):
            return text + ("\ufffd" if rest else ""), True
        return "", False
    return "", False


def decode_double(text: str, codec: str = "gbk") -> tuple[str, list[tuple[int, int, str]]]:
    """Double-byte case: whole runs of two-byte characters must spell UTF-8, else a run stays."""
    parts, out, done = [], [], 0
    for m in _HAN_RUN.finditer(text):
        start, end = m.span()
        lost = end < len(text) and text[end] == "\ufffd"
        try:
            raw = m.group().encode(codec)
        except UnicodeEncodeError:
            continue
        new, fits = _utf8_prefix(raw)
        # two bytes are valid UTF-8 by chance: such a letter must stand in a word, or be a common sign
        if len(raw) == 2 and not lost and new and not (text[start - 1 : start].isalpha() or text[end : end + 1].isalpha() or new in SEED_TEXT):
            continue
        # an incomplete last character is only taken where the sign of lost bytes follows
        if not fits or not new or new.endswith("\ufffd") and not lost:
            continue
        if not _plausible(text, start, end, new):
            continue
        stop = end + 1 if lost and new.endswith("\ufffd") else end
        parts.append((start, stop, new))
        out += [text[done:start], new]
        done = stop
    return "".join(out) + text[done:], parts


class Repairer:
    """Candidate chains and their description lengths."""

    def __init__(self, samples: dict[str, str]):
        self.pages = [CodePage(n) for n in SINGLE_BYTE]
        self.read = [CodePage(n) for n in READ]
        texts = {lang: samples.get(lang, "") + SEED_TEXT for lang in LANGUAGES}
        self.known = set().union(*texts.values())
        self.compressors = []
        for text in texts.values():
            raw = text.encode("utf-8")
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=3)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def length(self, text: str) -> int:
        """Shortest compressed size over the languages' dictionaries."""
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self.compressors)

    def gain(self, old: str, new: str, by_bytes: bool = True) -> float:
        """Bytes by which ``new`` is shorter than ``old``, over the part in which they differ.

        Equal ends are left out but for WINDOW characters of context: a small change isn't
        lost in the rounding of a long text's size.
        """
        limit = min(len(old), len(new))
        head = next((i for i in range(limit) if old[i] != new[i]), limit)
        tail = next((i for i in range(limit - head) if old[-1 - i] != new[-1 - i]), limit - head)
        head, tail = max(0, head - WINDOW), max(0, tail - WINDOW)
        old, new = old[head : len(old) - tail], new[head : len(new) - tail]
        raw = len(old.encode("utf-8", "surrogatepass")) - len(new.encode("utf-8", "surrogatepass")) if by_bytes else 0
        return self.length(old) - self.length(new) + RAW_BYTE_COST * raw

    def candidates(self, text: str) -> dict[str, tuple[tuple[str, ...], list[tuple[int, int, str]]]]:
        """Texts reachable by up to MAX_STEPS decodings, with the shortest chain that leads there."""
        found: dict[str, tuple[tuple[str, ...], list]] = {}
        level = {text: ((), [])}
        for _ in range(MAX_STEPS):
            following = {}
            for old, (chain, _) in level.items():
                if old.isascii():
                    continue
                # a text is read wrongly in the same page again, or in the most common one
                for page in self.pages:
                    if chain and page.name not in (*chain, "cp1252") and chain[-1] != "cp1252":
                        continue
                    new, parts = page.decode(old)
                    if parts and new not in found and new not in following:
                        following[new] = ((*chain, page.name), parts)
                for codec in DOUBLE_BYTE:
                    new, parts = decode_double(old, codec)
                    if parts and new not in found and new not in following:
                        following[new] = ((*chain, codec), parts)
            found |= following
            level = following
        if _HIGH_RUN.search(text):
            for page in self.read:
                for codec in WRITTEN:
                    if codec != page.name:
                        new, parts = decode_written(text, page, codec)
                        if parts and new not in found:
                            found[new] = ((f"{page.name}/{codec}",), parts)
        return found

    def repair(self, text: str | None) -> tuple[bool, str | None, str, bool]:
        """(garbled, text after repair, chain of decodings, whole original restored)."""
        if not text or text.isascii():
            return False, text, "", True
        found = self.candidates(text)
        best, chain, least = text, (), 0.0
        for new, (steps, _) in sorted(found.items(), key=lambda x: len(x[1][0])):
            legacy = "/" in steps[0]
            gain = self.gain(text, new, not legacy) - STEP_COST * len(steps)
            if legacy:
                whole = sum(b - a for a, b, _ in found[new][1])
                # a dictionary knows words of two signs or more; a sign that no sample has costs a byte more
                strange = sum(c not in self.known for _, _, part in found[new][1] for c in part)
                gain -= LEGACY_COST + LEGACY_SHARE * whole + strange
            if gain > least:
                best, chain, least = new, steps, gain
        garbled = bool(chain) or bool(_LOST.search(text))
        return garbled, best, ">".join(chain), not _LOST.search(best)


    def restored(self, text: str) -> str:
        """The text after repair."""
        return self.repair(text)[1] if _SUSPICIOUS.search(text) else text


_SUSPICIOUS = re.compile("[\ufffd\u0080-\u009f\ue000-\uf8ff\u4e00-\u9fff]|[^\x00-\x7f]{2}")


def suspicious(column: Column) -> Column:
    """JVM test for values that can hold a wrong decoding: lost bytes, runs of two signs, East Asian signs."""
    return F.coalesce(
        column.rlike("[\\uFFFD\\u0080-\\u009F\\uE000-\\uF8FF\\u4E00-\\u9FFF]|[^\\x00-\\x7F]{2}"), F.lit(False)
    )


def language_samples(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Bounded sample of texts per language, for the dictionaries.

    For each of LANGUAGES about twice DICTIONARY_TEXTS texts are chosen by the hash of the text. Of these the
    first DICTIONARY_TEXTS in alphabetical order are taken, of each only the first DICTIONARY_CHARS // 8
    characters, and DICTIONARY_CHARS characters in all. Values to be repaired are never cut. A count
    by language (no text is shuffled) sets the hash threshold; only texts under it are sent to the driver.
    """
    code = F.lower(F.substring(F.col(lang), 1, 2))
    usable = documents.where(code.isin(*LANGUAGES) & (F.length(text) >= 100)).select(
        code.alias("_lang"), F.col(text).alias("_text")
    )
    counts = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(
        *[F.lit(x) for lang_, n in counts.items() for x in (lang_, int(min(1.0, 2 * DICTIONARY_TEXTS / n) * 1_000_000))]
    )
    picked = usable.where(F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) < F.element_at(share, F.col("_lang")))
    rows = picked.select("_lang", F.substring("_text", 1, DICTIONARY_CHARS // 8).alias("_text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_lang"], r["_text"])):
        if not _LOST.search(r["_text"]):
            samples.setdefault(r["_lang"], []).append(r["_text"])
    return {k: "\n".join(v[:DICTIONARY_TEXTS])[:DICTIONARY_CHARS] for k, v in samples.items()}


def shared_repairer(spark: SparkSession, documents: DataFrame | None):
    """A function that gives a worker's Repairer; the samples (bounded, under 2 MB) are broadcast."""
    samples = spark.sparkContext.broadcast(language_samples(documents) if documents is not None else {})
    held: list[Repairer] = []

    def get() -> Repairer:
        if not held:
            held.append(Repairer(samples.value))
        return held[0]

    return get


def garbled_values(df: DataFrame, key: str, field: str, documents: DataFrame | None) -> DataFrame:
    """Garbled values only: (key, original, repaired, chain, restored)."""
    get = shared_repairer(df.sparkSession, documents)

    def rows(batch: list[dict]) -> Iterator[tuple]:
        repairer = get()
        for r in batch:
            garbled, repaired, chain, restored = repairer.repair(r["text"])
            if garbled:
                yield r["key"], r["text"], repaired, chain, restored

    source = df.where(suspicious(F.col(field))).select(F.col(key).cast("long").alias("key"), F.col(field).alias("text"))
    return arrow_pass(source, rows, "key long, original string, repaired string, chain string, restored boolean")
