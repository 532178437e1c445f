"""Mentions of references in article text: sentences, author-year matches, section, strength, distance, rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import compare_key, plain_characters, rejoin_hyphens, strip
from colophon.plans.runtime import arrow_pass

BOUNDS = frozenset("。！？.!?")
# Marks and spaces around a full stop that is no boundary, and abbreviations with one.
CLOSING = frozenset("\"'”’»›」』")
THIN = frozenset(" \t                 ​")
ABBREVIATIONS = ("dr.", "e.g.", "i.e.", "etc.", "vs.", "prof.", "mr.", "ms.")


def body_paragraphs(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, para_idx, text): cleaned non-blank paragraphs before the first one that reads 'references'."""
    c = strip(plain_characters(F.col("text")))
    cleaned = paragraphs.select(key, "para_idx", c.alias("text"))
    stop = F.min(F.when(F.lower("text") == "references", F.col("para_idx"))).over(Window.partitionBy(key))
    kept = cleaned.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("para_idx") < F.col("_stop")))
    return kept.select(key, "para_idx", rejoin_hyphens(F.col("text")).alias("text")).where("text <> ''")


def paren_depth(text: str) -> list[int]:
    """Depth of parentheses at each sign, the closing one still inside; never under zero."""
    depth, out = 0, []
    for ch in text:
        depth += ch == "("
        out.append(depth)
        if ch == ")":
            depth = max(0, depth - 1)
    return out


def plain_sentences(text: str | None) -> list[str]:
    """Sentences that end at . ! ? and their wide forms outside parentheses; not before a comma, not after 'et al.'."""
    if not text:
        return []
    out, start = [], 0
    for i, depth in enumerate(paren_depth(text)):
        ch = text[i]
        if ch not in BOUNDS or depth:
            continue
        if ch == "." and text[i + 1 : i + 2] == "," or text[max(0, i - 5) : i + 1].lower() == "et al.":
            continue
        out.append(text[start : i + 1].strip())
        start = i + 1
    out.append(text[start:].strip())
    return [s for s in out if s]


def stop_is_inner(text: str, i: int, intended: bool = False) -> bool:
    """Whether the full stop at i ends no sentence: before a comma, or before a closing mark with comma or stop.

    The published rules for 'et al.', abbreviations and numbers never take effect, as their lengths don't
    fit; ``intended`` applies them as they are described.
    """
    def skip(k: int) -> int:
        while k < len(text) and text[k] in THIN:
            k += 1
        return k

    j = skip(i + 1)
    if j >= len(text):
        return False
    if text[j] == ",":
        return True
    if text[j] in CLOSING and text[skip(j + 1) : skip(j + 1) + 1] in (",", "."):
        return True
    head = text[: i + 1].lower()
    if intended:
        return head.endswith("et al.") or head.endswith(ABBREVIATIONS) or i > 0 and text[i - 1].isdigit()
    return i >= 2 and text[i - 2 : i] in ("1.", "2.", "3.")


def enclosing_sentence(text: str, start: int, end: int, intended: bool = False) -> str:
    """The sentence around a match: to the nearest boundary outside parentheses on either side."""
    depth = paren_depth(text)
    bound = lambda i: text[i] in BOUNDS and depth[i] == 0 and not (text[i] == "." and stop_is_inner(text, i, intended))
    left = next((i + 1 for i in range(max(0, start - 1), -1, -1) if i < len(text) and bound(i)), 0)
    right = next((i + 1 for i in range(end, len(text)) if bound(i)), len(text))
    return text[left:right].strip()


def sentence_index(body: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_pos, para_idx, sent): sentences of a document in order."""

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            for n, sentence in enumerate(plain_sentences(r["text"])):
                yield r["k"], r["para_idx"], n, sentence

    kind = dict(body.dtypes)[key]
    parts = arrow_pass(body.select(F.col(key).alias("k"), F.col("para_idx").cast("int").alias("para_idx"), "text"), rows, f"k {kind}, para_idx int, n int, sent string")
    order = Window.partitionBy("k").orderBy("para_idx", "n")
    return parts.select(F.col("k").alias(key), F.row_number().over(order).alias("sent_pos"), "para_idx", "sent")


def context(index: DataFrame, key: str = "doc_id", window: int = 3) -> DataFrame:
    """Adds `context`: the sentence with ``window`` sentences on either side, across paragraphs."""
    around = Window.partitionBy(key).orderBy("sent_pos").rowsBetween(-window, window)
    return index.withColumn("context", F.array_join(F.collect_list("sent").over(around), " "))


@lru_cache(4096)
def _name(surname: str, intended: bool) -> re.Pattern:
    """Pattern of a surname as a whole word; a hyphen may be any dash, with space after it."""
    signs = {"-": r"[\-‐-―]\s*", "'": "['’]" if intended else "'"}
    return re.compile(rf"(?<![\w@./]){''.join(signs.get(ch) or re.escape(ch) for ch in surname.strip())}(?!\w)", re.IGNORECASE)


@lru_cache(512)
def _tails(year: int) -> tuple[re.Pattern, ...]:
    """What may follow the surname up to the year; it doesn't depend on the surname, so few patterns are compiled."""
    person = r"[^\W\d_][\w’'‐-―-]*(?:\s[^\W\d_][\w’'‐-―-]*){0,3}?"
    company = rf"(?:\s*,\s*{person}){{0,20}}\s*,?\s*(?:and\b|&)\s*{person}"
    author = rf"(?:\s+et\s+al\b\.?|{company})?"
    one = r"\d{4}[a-z]?"
    years = rf"(?:{one}\s*[,;]\s*)*{year}[a-z]?(?!\w)"
    return tuple(re.compile(author + f, re.IGNORECASE) for f in (rf"\s*\(\s*{years}[^()]{{0,80}}\)", rf"\s*,?\s*{years}"))


def find_mentions(text: str, surname: str, year: int, intended: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the APA and Harvard mentions of a first author and year, upper or lower case.

    A mention is an author part and a year part:

    author  the surname, alone, with 'et al.', or with up to 20 further names before 'and' or '&'
    year    a list of years, each with an optional letter, that holds the year

    In running text the years are in parentheses, with up to 80 signs of a locator behind them; inside
    parentheses, in lists of mentions and without any brackets, the years follow the author, with or without comma.
    """
    found = []
    for name in _name(surname, intended).finditer(text):
        ends = [m.end() for tail in _tails(year) if (m := tail.match(text, name.end()))]
        if ends:
            found.append((name.start(), ends[0]))
    return found


def mentions(body: DataFrame, targets: DataFrame, key: str = "doc_id", intended: bool = False) -> DataFrame:
    """(key, para_idx, sentence, ref_text, first_at): sentences that mention a target reference.

    Joined by document, matched by pattern; the patterns of names and years are kept by each worker.
    Targets without surname match nothing.
    """
    # the surname without its hyphens and apostrophes must occur before any pattern is tried
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    wanted = targets.where("surname <> '' and ref_year >= 0").select(key, "ref_text", "surname", "ref_year", plain(F.col("surname")).alias("_name"))
    found = body.select(key, "para_idx", "text", plain(F.col("text")).alias("_plain")).join(wanted, key).where(F.contains("_plain", "_name"))
    pairs = found.select(F.col(key).alias("k"), F.col("para_idx").cast("int").alias("para_idx"), "text", "ref_text", "surname", "ref_year")

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            first: dict[str, int] = {}
            for start, end in find_mentions(r["text"], r["surname"], r["ref_year"], intended):
                first.setdefault(enclosing_sentence(r["text"], start, end, intended), start)
            for sentence, at in first.items():
                yield r["k"], r["para_idx"], sentence, r["ref_text"], at

    kind = dict(body.dtypes)[key]
    return arrow_pass(pairs, rows, f"k {kind}, para_idx int, sentence string, ref_text string, first_at int").withColumnRenamed("k", key)


def hits(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per (key, para_idx, sentence): the sorted references it mentions."""
    return found.groupBy(key, "para_idx", "sentence").agg(F.sort_array(F.collect_set("ref_text")).alias("matched"), F.min("first_at").alias("first_at"))


def strength(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds strength (sentences of the document that mention the reference) and the largest within the sentence."""
    per_ref = found.dropDuplicates([key, "para_idx", "sentence", "ref_text"]).withColumn(
        "strength", F.count(F.lit(1)).over(Window.partitionBy(key, "ref_text"))
    )
    return per_ref.withColumn("strength_max", F.max("strength").over(Window.partitionBy(key, "para_idx", "sentence")))


def sections(rows: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds `section_name`: the last heading (key, index, text) at or before para_idx, else 'Unknown'.

    A union and a running last value: one shuffle by document, no range join.
    """
    a = headings.select(F.col(key), F.col("index").cast("int").alias("para_idx"), F.col("text").alias("_h"), F.lit(None).cast("string").alias("_row"), F.lit(0).alias("_turn"))
    packed = rows.select(F.col(key), F.col("para_idx").cast("int").alias("para_idx"), F.lit(None).cast("string").alias("_h"), F.to_json(F.struct(*rows.columns)).alias("_row"), F.lit(1).alias("_turn"))
    order = Window.partitionBy(key).orderBy("para_idx", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(packed).withColumn("section_name", F.coalesce(F.last("_h", True).over(order), F.lit("Unknown"))).where("_turn = 1")
    return both.select(F.from_json("_row", rows.schema).alias("r"), "section_name").select("r.*", "section_name")


def distance(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds `distance` of each row to the nearest row of another reference in its document.

    Windows instead of a self-join: a set holds another reference exactly if its least and greatest
    differ. One reference in a document: 'only one self-citation'; a blank sentence: 'DifferentSection'.
    """
    several = lambda *keys: F.min("ref_text").over(Window.partitionBy(*keys)) != F.max("ref_text").over(Window.partitionBy(*keys))
    sentence = F.trim(F.coalesce(F.col("sentence"), F.lit("")))
    tagged = rows.withColumn("_s", sentence)
    level = (
        F.when(~several(key), "only one self-citation").when(F.col("_s") == "", "DifferentSection").when(several(key, "_s"), "SameSentence")
        .when((F.col("para_idx") != -1) & several(key, "para_idx"), "SameParagraph").when((F.col("section_name") != "") & several(key, "section_name"), "SameSection")
        .otherwise("DifferentSection")
    )
    return tagged.withColumn("distance", level).drop("_s")


def distance_by_join(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same level by a non-equal self-join; the twin that the window form is checked against."""
    a = rows.select(key, "row_id", "ref_text", "para_idx", "section_name", F.trim(F.coalesce("sentence", F.lit(""))).alias("s"))
    b = a.select(key, F.col("ref_text").alias("ref_b"), F.col("para_idx").alias("para_b"), F.col("section_name").alias("sec_b"), F.col("s").alias("s_b"))
    level = (
        F.when(F.col("s") == F.col("s_b"), 0).when((F.col("para_idx") != -1) & (F.col("para_idx") == F.col("para_b")), 1)
        .when((F.col("section_name") != "") & (F.col("section_name") == F.col("sec_b")), 2).otherwise(3)
    )
    near = a.join(b, (a[key] == b[key]) & (F.col("ref_text") != F.col("ref_b"))).select("row_id", level.alias("level")).groupBy("row_id").agg(F.min("level").alias("level"))
    names = F.array(*map(F.lit, ["SameSentence", "SameParagraph", "SameSection", "DifferentSection"]))
    return rows.join(near, "row_id", "left").withColumn(
        "distance",
        F.when(F.col("level").isNull(), "only one self-citation").when(F.trim(F.coalesce("sentence", F.lit(""))) == "", "DifferentSection").otherwise(F.get(names, F.col("level"))),
    ).drop("level")


#: Order of a reference that isn't listed, and place of a paragraph that isn't known: behind all others.
LAST = 1_000_000_000


def with_ref_order(rows: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``ref_order`` of each row's reference; LAST where it isn't listed."""
    listed = targets.groupBy(key, "ref_text").agg(F.min("ref_order").alias("ref_order"))
    return rows.join(listed, [key, "ref_text"], "left").withColumn("ref_order", F.coalesce("ref_order", F.lit(LAST)))


def with_placeholders(targets: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of found mentions, and a placeholder (blank sentence, para_idx -1) for each target without mention."""
    listed = targets.groupBy(key, "ref_text").agg(F.min("ref_order").alias("ref_order"))
    bare = listed.join(rows.select(key, "ref_text").distinct(), [key, "ref_text"], "left_anti")
    found = rows.join(listed, [key, "ref_text"])
    return found.unionByName(bare.withColumns({"sentence": F.lit(""), "para_idx": F.lit(-1)}), allowMissingColumns=True)


def first_per_sentence(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per (reference, sentence) of a document: the first by paragraph."""
    order = Window.partitionBy(key, "ref_text", "sentence").orderBy("para_idx")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def final_order(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds `position`: numeric document ids first, then reference order, paragraph (blank last), sentence."""
    number = F.expr(f"try_cast({key} as double)")
    late = F.when(F.col("para_idx") == -1, LAST).otherwise(F.col("para_idx"))
    order = Window.partitionBy(key).orderBy(F.coalesce("ref_order", F.lit(LAST)), late, "sentence")
    return rows.withColumn("doc_number", number).withColumn("position", F.row_number().over(order)).orderBy(
        F.col("doc_number").asc_nulls_last(), key, "position"
    )


def lookup_sentence(index: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds sent_pos: the first sentence of the document that is equal without white space and case; NULL if none."""
    first = index.select(key, compare_key(F.col("sent")).alias("_k"), "sent_pos").groupBy(key, "_k").agg(F.min("sent_pos").alias("sent_pos"))
    return sentences.withColumn("_k", compare_key(F.col("sentence"))).join(first, [key, "_k"], "left").drop("_k")


def annotate(paragraphs: DataFrame, targets: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents to mention rows: match, strength, placeholders, section, de-duplication, context, distance."""
    body = body_paragraphs(paragraphs, key)
    index = context(sentence_index(body, key), key)
    found = strength(mentions(body, targets, key), key)
    rows = first_per_sentence(with_placeholders(targets, found.select(key, "ref_text", "sentence", "para_idx", "strength", "first_at"), key), key)
    placed = distance(sections(rows, headings, key), key)
    located = lookup_sentence(index, placed, key)
    return located.join(index.select(key, "sent_pos", "context"), [key, "sent_pos"], "left").withColumn(
        "context", F.coalesce("context", "sentence")
    ).drop("sent_pos")


def linked_context(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Approximation of the context rule by a word list: the sentence before joins if the sentence opens with
    a connective, demonstrative, third-person or first-person-plural word; the one after if that one does."""
    order = Window.partitionBy(key).orderBy("sent_pos")
    linked = F.col("sent").rlike(r"(?i)^\W*(?:however|moreover|furthermore|therefore|thus|hence|similarly|in addition|in contrast|this|that|these|those|such|it|its|they|their|he|she|we|us|our)\b")
    before, after = F.lag("sent").over(order), F.lead("sent").over(order)
    flagged = index.withColumn("_l", linked)
    next_linked = F.lead("_l").over(order)
    return flagged.withColumn("linked_context", F.concat_ws(" ", F.when(F.col("_l"), before), F.col("sent"), F.when(next_linked, after))).drop("_l")


def heading_text(text: Column) -> Column:
    """Whether a line reads like a heading: one to five words, the first capitalised; not abstract, keywords or references."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9\-/]*)"), 1)
    plain = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"\.+$", ""))
    return (F.size(words) > 0) & (F.size(words) <= 5) & F.get(words, F.lit(0)).rlike("^[A-Z]") & ~plain.isin("abstract", "keywords", "key words", "references")


def is_heading(text: Column, runs: Column) -> Column:
    """Heading predicate over styled runs (text, fonts, size_pt, bold, italic), weighted by characters.

    At least 60 % in the heading font, at most 40 % italic, 60 % bold, 60 % of the known sizes right; the
    first word capitalised, at most five words; not abstract, keywords or references.
    """
    chars = lambda keep: F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + F.when(keep(r), F.length(r["text"])).otherwise(0))
    total = chars(lambda r: F.lit(True))
    share = lambda a, b: F.try_divide(a, b)
    font = share(chars(lambda r: F.exists(r["fonts"], lambda f: F.lower(f).contains("times new roman"))), total)
    size = share(chars(lambda r: F.coalesce(r["size_pt"] == 11, F.lit(False))), chars(lambda r: r["size_pt"].isNotNull()))
    return F.coalesce(
        (total > 0) & (font >= 0.6) & (share(chars(lambda r: r["italic"]), total) <= 0.4) & (share(chars(lambda r: r["bold"]), total) >= 0.6)
        & F.coalesce(size >= 0.6, F.lit(True)) & heading_text(text),
        F.lit(False),
    )


_STOP = (
    r"(?i)^\s*key ?words", r"(?i)^\s*subject(?:s|\(s\))?\s*:?", r"(?i)publishing\s+services\s+by\s+elsevier", r"^\s*\d+(?:\.\d+)*\.?\s+[A-Z]", r"(?i)^\s*references\s*$"
)


def stop_line(c: Column) -> Column:
    """Lines that end an abstract: keywords, subjects, publisher, numbered heading, short capitals, references."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    capitals = (F.size(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1)).between(1, 6)) & (F.try_divide(F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")), letters) > 0.8)
    out = capitals
    for p in _STOP:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def abstracts(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, abstract): inline header, else separate header, else any line with the word; text boxes if the body has none.

    ``paragraphs`` has para_idx, text and source ('body' or 'textbox'). Each way is one conditional minimum
    of start and stop over the document; '' where nothing is found.
    """
    c = F.trim(F.regexp_replace(plain_characters(F.col("text")), r"[\s\p{Z}]+", " "))
    lines = paragraphs.select(key, "source", "para_idx", c.alias("t")).where("t <> ''")
    spaced = r"(?i)^\s*a\s*[\W_]*b\s*[\W_]*s\s*[\W_]*t\s*[\W_]*r\s*[\W_]*a\s*[\W_]*c\s*[\W_]*t\s*:?\s*$"
    inline, alone = F.col("t").rlike(r"(?i)^\s*abstract\s*:?\s*"), (F.lower("t") == "abstract") | F.col("t").rlike(spaced)
    ways = [("inline", inline), ("after", alone), ("loose", F.lower("t").contains("abstract") | F.col("t").rlike(spaced))]
    whole = Window.partitionBy(key, "source")
    marked = lines.withColumn("stop", stop_line(F.col("t")))
    for name, rule in ways:
        marked = marked.withColumn(f"from_{name}", F.min(F.when(rule, F.col("para_idx"))).over(whole))
    for name, _ in ways:
        marked = marked.withColumn(f"to_{name}", F.min(F.when(F.col("stop") & (F.col("para_idx") > F.col(f"from_{name}")), F.col("para_idx"))).over(whole))
    separator = F.col("t").rlike(r"^[-=_·•\x{2500}\x{2014}\x{2015}\x{2212}\s]+$")

    def collected(name: str) -> Column:
        inside = (F.col("para_idx") > F.col(f"from_{name}")) & (F.col(f"to_{name}").isNull() | (F.col("para_idx") < F.col(f"to_{name}")))
        piece = F.when(inside & ~(separator if name == "after" else F.lit(False)), rejoin_hyphens(F.col("t")))
        if name == "inline":
            head = F.trim(rejoin_hyphens(F.regexp_replace("t", r"(?i)^\s*abstract\s*:?\s*", "")))
            piece = F.when(F.col("para_idx") == F.col("from_inline"), F.nullif(head, F.lit(""))).otherwise(piece)
        listed = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct(F.col("para_idx").alias("i"), piece.alias("p")))))
        return F.nullif(F.trim(F.array_join(F.transform(listed, lambda s: s["p"]), " ")), F.lit(""))

    per = marked.groupBy(key, "source").agg(*[collected(n).alias(n) for n, _ in ways])
    chosen = per.withColumn("abstract", F.coalesce("inline", "after", "loose"))
    return chosen.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("source") == "body", F.col("abstract"))), F.max(F.when(F.col("source") == "textbox", F.col("abstract"))), F.lit("")).alias("abstract")
    )
