"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class of every white space sign, also those that trim() leaves; Java and RE2 read it alike.
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
# Ambiguous characters of copied article text.
SPACES = "         "
REMOVED = "­​"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
#: Contexts under so many characters are short; over so many dashes, suspicious.
SHORT, DASHES = 350, 10


def strip(c: Column) -> Column:
    """Outer white space of any kind dropped."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def plain_characters(c: Column) -> Column:
    """Full-width parentheses, special spaces, soft hyphens and ligatures to plain characters."""
    out = F.translate(c, "（）" + SPACES + REMOVED, "()" + " " * len(SPACES))
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def one_line(c: Column) -> Column:
    """White space collapsed to single spaces, outer space dropped."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def clean_reference(c: Column) -> Column:
    return one_line(plain_characters(c))


def clean_context(c: Column) -> Column:
    """White space collapsed, then runs of two or more dashes to a space (double spaces may stay), trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, BLANK + "+", " "), "[-–—]{2,}", " "))


def rejoin_hyphens(c: Column) -> Column:
    """A word broken as `Lock- down` joined again; a letter, digit or underscore on both sides."""
    return F.regexp_replace(c, r"([\p{L}\p{N}_])[\-\x{2010}-\x{2014}]\s+([\p{L}\p{N}_])", "$1$2")


def compare_key(c: Column) -> Column:
    """Text for comparison: plain characters, no white space, lower case."""
    return F.lower(F.regexp_replace(plain_characters(c), BLANK + "+", ""))


def cell_text(c: Column) -> Column:
    """Cell value as text: white space collapsed and trimmed, NULL as empty."""
    return F.coalesce(one_line(c), F.lit(""))


def dash_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "-–—", ""))


def year_count(c: Column) -> Column:
    """Distinct year tokens; 2020 and 2020a are two."""
    # every year is followed by what isn't a word sign, and none may follow one
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])((?:19|20)\d{2}[a-z]?)(?![\p{L}\p{N}_])"), 1)))


def context_flag(c: Column) -> Column:
    """short, dashes, years or '': the first that applies; dashes and years only count for contexts that aren't short."""
    return (
        F.when(F.length(clean_context(c)) < SHORT, "short").when(dash_count(c) > DASHES, "dashes").when(year_count(c) > 1, "years").otherwise("")
    )


def starts_upper(c: Column) -> Column:
    """Whether the first letter has case and is upper."""
    first = F.regexp_extract(c, r"\p{L}", 0)
    return (first != "") & (F.upper(first) == first) & (F.lower(first) != first)


def paren_profile(c: Column) -> Column:
    """(deepest, open_at_end) of the parentheses of a text; a closing one without an open one counts for nothing."""
    signs = F.regexp_extract_all(c, F.lit(r"([()])"), 1)
    start = F.struct(F.lit(0).alias("deepest"), F.lit(0).alias("open_at_end"))

    def step(s: Column, sign: Column) -> Column:
        depth = F.greatest(F.lit(0), s["open_at_end"] + F.when(sign == "(", 1).otherwise(-1))
        return F.struct(F.greatest(s["deepest"], depth).alias("deepest"), depth.alias("open_at_end"))

    return F.aggregate(signs, start, step)
