"""Problem 1: text cut off by field limits.

Method: tries of the corpus, held as tables of their nodes (prefix, occurrences of longer items, occurrences of the
prefix itself), flag values that end in an unknown proper prefix of known items; lengths at which a source's
values pile up are the further evidence.

1. Trie of the vocabulary: the final token is no known word (or hardly ever one) but begins known words. Since a
   rare word may begin others by chance, the length of a limit or the second trie must agree.
2. Trie of sentence shapes, the same test for cuts between words: the last sentence reads like the beginning of
   known sentences and (nearly) never like a whole one, or its last word never ends a sentence of the corpus.
   A shape keeps function words, marks and brackets and replaces other words, names, years and numbers by their class.
3. Marks: a mark of omission, a bracket left open, a final sign that ends no sentence.

A sentence of a kind that the corpus doesn't have is evidence of nothing, so an ordinary finished sentence without full
stop isn't flagged. All counts cover all values; each value is read, repaired and cleaned once, in one pass that gives
both the counts and the values that may be cut.

Defined cases: NULL, empty, blank and placeholder values are never truncated; a finished sentence
without full stop isn't either. Repeated rows of a mention count once in the report.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.encoding import shared_repairer
from colophon.llm.lookalike import canonical
from colophon.plans.runtime import cut_lineage

# Cells that stand for a missing text.
PLACEHOLDERS = frozenset(("", "-", "--", "–", "—", "n/a", "na", "none", "null", "nan", "nil", "not available", "missing", "tbd", "?", "."))
# English function words, kept in shapes.
FUNCTION_WORDS = frozenset(
    """a an the this that these those some any each every no not nor and or but so yet if because although though while
    whereas when where which who whom whose what how than as of in on at by for from to into onto with without within
    across between among through during before after above below over under about against toward towards per via once
    is are was were be been being am has have had having do does did can could may might must shall should will would
    it its they them their he she his her we us our you your i my one two both either neither only also just then
    there here such same other another more most less least very too again ever never always already still out up down
    off unlike like despite following given namely together rather""".split()
)
# Abbreviations whose full stop isn't the end of a sentence.
ABBREVIATED = frozenset("e.g i.e fig figs cf vs no nos vol p pp sect eq eqs tab dr prof mr mrs ms st approx ca resp".split())

_TOKEN = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|[^\W\d_]+(?:[-’'][^\W\d_]+)*|\d+(?:[.,:]\d+)*[a-z]?|\.\.\.|[^\w\s]")
_WORD = re.compile(r"(?<![^\W_])[^\W\d_]+")
#: The last token, where it is a word.
_LAST_WORD = re.compile(r"(?<![^\W_])([^\W\d_]+)\W*$")
_YEAR = re.compile(r"(?:1[6-9]|20)\d\d[a-z]?")
_ET_AL = re.compile(r"\bet al\.?")
_INNER_END = re.compile(r"(?<=[.!?;])[”\"’»)\]]*\s+(?=[“\"«(]?[^\W\d_a-zß-ÿ])|[。！？][”’」』）]*")
_OMISSION = re.compile(r"(?:\.\s?\.\s?\.|\.\.|…|⋯|\[\s*(?:…|\.\.\.)?\s*\]?|[\[(<](?:cut|truncated|continued|cont\.?|more|snip)[\])>])[\s\])”\"’.]*$", re.IGNORECASE)
_FINISHED = re.compile(r"[.!?。！？؟।…][\"”’»)\]」』）]*$")


class _Classes(dict):
    """Class of a token in a shape, kept for tokens met before (a bounded number)."""

    def __missing__(self, token: str) -> str:
        if len(self) > 100_000:
            self.clear()
        head = token[0]
        if head in "([" and len(token) > 1:
            out = "C" if any(c.isdigit() for c in token) else "P"
        elif head.isdigit():
            out = "Y" if _YEAR.fullmatch(token) else "N"
        elif head.isalpha():
            low = token.lower()
            out = low if low in FUNCTION_WORDS else "A" if head.isupper() else "w"
        else:
            out = token
        self[token] = out
        return out


_CLASSES = _Classes()


def shape(sentence: str) -> str:
    """Shape of a sentence without its final full stop: function words, marks and word classes."""
    if "et al" in sentence:
        sentence = _ET_AL.sub(" ", sentence)
    return " ".join(map(_CLASSES.__getitem__, _TOKEN.findall(sentence))).rstrip(" .!?。！？")


def collapsed(full: str) -> str:
    """The shape with runs of word classes reduced to one."""
    return re.sub(r"\b([wA])(?: [wA])+\b", r"\1", full)


def last_sentence(text: str) -> str:
    """Text after the last boundary inside a value."""
    end = 0
    for m in _INNER_END.finditer(text):
        if m.end() < len(text):
            end = m.end()
    return text[end:]


def clean(text: str, repair) -> str:
    """The value as it should read: encoding repaired, look-alikes in one form, outer space dropped."""
    if not text.isascii():
        text = canonical(repair(text)).replace("\ufffd", "")
    return text.strip()


def _ending(text: str) -> str:
    """How a cleaned value ends: '' finished, 'omission', 'abbreviation', 'number' or 'open'."""
    text = text[-80:]
    if _OMISSION.search(text):
        return "omission"
    if not _FINISHED.search(text):
        return "open"
    if text[-1] == "." and text[:-1].strip():
        word = text[:-1].split()[-1].lower().lstrip("(“\"[")
        if word in ABBREVIATED or text.endswith("et al."):
            return "abbreviation"
        if word.isdigit() or re.fullmatch(r"\d+[.,]\d+", word):
            return "number"
    return ""


PASS_SCHEMA = (
    "kind string, item string, n long, key long, source string, size int, ending string, tail string, final string, full string, short string, before string, mark string, open boolean"
)


def _pass(rows: DataFrame, get) -> DataFrame:
    """One row per count of a batch (kind, item, n) and one per value that may be cut (kind 'v').

    Kinds: 'w' words, 'e' words that end sentences, 's' shapes and 'c' collapsed shapes of whole sentences. The final token of
    a value without full stop isn't counted: it may be a fragment.
    """
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [(f.split()[0], types[f.split()[1]]) for f in PASS_SCHEMA.split(", ")]

    def count(batches):
        for batch in batches:
            words, ends, sentences, found = Counter(), Counter(), Counter(), []
            for key, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text.strip().lower() in PLACEHOLDERS:
                    continue
                value = clean(text, get().restored)
                if not value:
                    continue
                ending = _ending(value)
                tokens = _WORD.findall(value.lower())
                words.update(tokens if not ending else tokens[:-1])
                done = 0
                for m in _INNER_END.finditer(value):
                    if m.end() < len(value):
                        sentences[value[done : m.end()]] += 1
                        done = m.end()
                last = value[done:]
                if not ending:
                    sentences[last] += 1
                    continue
                tail, final = re.search(r"[^\W\d_]+$", value), _LAST_WORD.search(value[-80:])
                full = shape(last)
                before = shape(last[: len(last) - len(tail.group())]) if tail else full
                found.append((
                    "v", None, None, key, source, len(text), ending, tail.group().lower() if tail else None, final.group(1).lower() if final else None, full, collapsed(full), before,
                    value[-1], max(value.rfind("("), value.rfind("[")) > max(value.rfind(")"), value.rfind("]")),
                ))
            shapes = Counter()
            for sentence, n in sentences.items():
                last_word = _LAST_WORD.search(sentence[-80:])
                if last_word and sentence.rstrip("”\"’»)] ")[-1:] in ".!?。！？":
                    ends[last_word.group(1).lower()] += n
                shapes[shape(sentence)] += n
            short = Counter()
            for full, n in shapes.items():
                short[collapsed(full)] += n
            rest = (None,) * (len(fields) - 3)
            counted = [(kind, item, n, *rest) for kind, counts in (("w", words), ("e", ends), ("s", shapes), ("c", short)) for item, n in counts.items()]
            columns = list(zip(*(counted + found), strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    return rows.mapInArrow(count, PASS_SCHEMA)


def trie_nodes(items: DataFrame, by: str = "") -> DataFrame:
    """Nodes of the trie of (item, n), over signs or, with ``by``, over parts: prefix, n_below (longer items) and n_own (the prefix itself)."""
    size = F.size(F.split("item", by)) if by else F.length("item")
    prefix = F.expr(f"substring_index(item, '{by}', size)") if by else F.expr("substring(item, 1, size)")
    return (
        items.select("item", "n", size.alias("whole"), F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).alias("size"))
        .select(prefix.alias("prefix"), "n", (F.col("whole") == F.col("size")).alias("own"))
        .groupBy("prefix")
        .agg(F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("n_below"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("n_own"))
    )


#: Values that must have exactly the length of a limit, and their least share among a source's long values.
PILE, PILE_SHARE = 3, 0.05


def field_limits(lengths: DataFrame) -> DataFrame:
    """Lengths at which the values of a source pile up: (source, size)."""
    per = lengths.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    beyond = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        per.withColumn("at_least", F.sum("n").over(beyond))
        .where((F.col("n") >= PILE) & (F.col("n") >= PILE_SHARE * F.col("at_least")) & (F.col("size") >= 50))
        .select("source", "size")
    )


#: A word or sentence that occurs so rarely beside the longer ones it begins counts as unknown.
RARE_WORD, RARE_SENTENCE = 200, 20
#: Occurrences from which a word that never ends a sentence is taken not to end this one.
KNOWN = 10


def truncated_values(
    df: DataFrame, key: str = "mention_id", text: str = "citation_content", source: str = "workbook", documents: DataFrame | None = None
) -> DataFrame:
    """Truncated values, one row per key: (key, source, size, reason, at_limit, last_token).

    ``reason``: omission (a mark of omission), open (after a sign or inside a bracket that can't end a sentence), word
    (inside a word, by the trie of words), sentence (before the sentence is finished, by the trie of shapes and last words).
    """
    get = shared_repairer(df.sparkSession, documents)
    rows = df.where(F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")
    )
    passed = cut_lineage(_pass(rows, get))
    counts = cut_lineage(passed.where("kind <> 'v'").groupBy("kind", "item").agg(F.sum("n").alias("n")))
    found = cut_lineage(passed.where("kind = 'v'").drop("kind", "item", "n").dropDuplicates(["key"]))
    of = lambda kind: counts.where(F.col("kind") == kind).select("item", "n")

    def looked_up(rows: DataFrame, kind: str, by: str, columns: dict[str, str]) -> DataFrame:
        """Adds n_below and n_own of the node that each column names, as below_name and own_name; the trie is made once."""
        asked = rows.select(F.explode(F.array(*columns)).alias("prefix")).where(F.col("prefix").isNotNull()).distinct()
        nodes = trie_nodes(of(kind), by).join(asked, "prefix", "left_semi")
        nodes = cut_lineage(nodes) if len(columns) > 1 else nodes
        for column, name in columns.items():
            named = nodes.select(F.col("prefix").alias(column), F.col("n_below").alias(f"below_{name}"), F.col("n_own").alias(f"own_{name}"))
            rows = rows.join(named, column, "left").fillna(0, [f"below_{name}", f"own_{name}"])
        return rows

    last = counts.where("kind in ('e', 'w')").groupBy(F.col("item").alias("final")).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "e", F.col("n"))), F.lit(0)).alias("n_end"), F.coalesce(F.sum(F.when(F.col("kind") == "w", F.col("n"))), F.lit(0)).alias("n_word")
    )
    limits = field_limits(rows.select("source", F.length("text").alias("size"), "key").dropDuplicates(["key"])).withColumn("at_limit", F.lit(True))
    joined = found.join(last, "final", "left").fillna(0, ["n_end", "n_word"]).join(limits, ["source", "size"], "left").fillna(False, ["at_limit"])
    for kind, by, columns in (("w", "", {"tail": "word"}), ("s", " ", {"full": "full", "before": "before"}), ("c", " ", {"short": "short"})):
        joined = looked_up(joined, kind, by, columns)
    c = F.col
    unknown = c("tail").isNotNull() & (c("own_word") == 0)
    fragment = c("tail").isNotNull() & (c("below_word") > 0) & ((c("own_word") == 0) | (c("own_word") * RARE_WORD < c("below_word")) & (c("n_end") == 0))
    begun = (c("before") == "") | (c("below_before") > 0)
    goes_on = (c("below_full") > 0) & (c("own_full") * RARE_SENTENCE < c("below_full")) | (c("own_full") == 0) & (c("below_short") >= 3) & (c("own_short") == 0)
    function = c("final").isin(*sorted(FUNCTION_WORDS))
    never_last = (c("n_word") >= KNOWN) & ((c("n_end") == 0) | function & (c("n_end") * RARE_WORD < c("n_word")))
    reason = (
        F.when(c("ending") == "omission", "omission")
        .when((c("ending") == "open") & (c("mark").rlike(r"[,;:(\[“„«‘&/–—-]") | c("open")), "open")
        .when((c("ending") == "open") & (fragment & (c("at_limit") | begun) | unknown & c("at_limit")), "word")
        .when(goes_on, "sentence")
        .when((c("ending") == "open") & never_last & (function | c("at_limit") | (c("below_full") > 0) | (c("below_short") > 0)), "sentence")
    )
    return joined.select(
        c("key").alias(key), c("source").alias(source), "size", reason.alias("reason"), "at_limit", c("final").alias("last_token")
    ).where(c("reason").isNotNull())
