"""Articles as .docx files: listing, full text, body paragraphs with styled runs, text boxes.

A file is read once, by one task, from its bytes (binaryFile), with the standard library only.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass

# Fixed value: namespace of the main document part.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY, BOX, OTHER = "body", "textbox", "other"
RUNS = "array<struct<text:string,fonts:array<string>,size_pt:double,bold:boolean,italic:boolean>>"
#: Signs that are dropped from the full text.
_DROPPED = re.compile("[﻿\u000b​]")


def article_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_id, number, content): .docx files of a folder; ``doc_id`` is the name without ending, ``number`` the first
    whole number in it (NULL without one). Lock files of editors (names that begin with ~$) are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(folder)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    named = files.select("path", F.regexp_replace(name, r"(?i)\.docx$", "").alias("doc_id"), "content").where(~F.col("doc_id").startswith("~$"))
    return named.withColumn("number", F.expr(r"try_cast(regexp_extract(doc_id, '[0-9]+', 0) as bigint)"))


def file_order() -> list[Column]:
    """Order of articles: by number, those without last, then by name whatever its case."""
    return [F.col("number").asc_nulls_last(), F.lower("doc_id"), F.col("doc_id")]


def _flag(properties, tag: str) -> bool | None:
    node = None if properties is None else properties.find(W + tag)
    return None if node is None else node.get(W + "val", "true").lower() not in ("0", "false", "off", "none")


def _traits(properties) -> dict:
    """What a set of run properties states about fonts, size, weight and slope; nothing for what it leaves open."""
    fonts = None if properties is None else properties.find(W + "rFonts")
    names = [] if fonts is None else sorted({v for k, v in fonts.attrib.items() if k.startswith(W) and "heme" not in k and k != W + "hint"})
    size = None if properties is None else properties.find(W + "sz")
    value = None if size is None else size.get(W + "val")
    return {"fonts": names or None, "size_pt": float(value) / 2 if value else None, "bold": _flag(properties, "b"), "italic": _flag(properties, "i")}


class Styles:
    """Traits of the named styles, with those of the styles they are based on."""

    def __init__(self, xml: bytes | None):
        self.own, self.base, self.default, self.fallback = {}, {}, {}, None
        if xml is None:
            return
        root = ElementTree.fromstring(xml)
        for style in root.iter(W + "style"):
            key = style.get(W + "styleId")
            self.own[key] = _traits(style.find(W + "rPr"))
            based = style.find(W + "basedOn")
            self.base[key] = None if based is None else based.get(W + "val")
            if style.get(W + "type") == "paragraph" and style.get(W + "default") in ("1", "true"):
                self.fallback = key
        found = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
        self.default = _traits(found)

    def chain(self, key: str | None) -> Iterator[dict]:
        seen = set()
        while key in self.own and key not in seen:
            seen.add(key)
            yield self.own[key]
            key = self.base[key]


def _text(node) -> str:
    """Text of a run or paragraph: tabs and breaks included, text boxes left out."""
    out = []
    for child in node:
        if child.tag == W + "t":
            out.append(child.text or "")
        elif child.tag == W + "tab":
            out.append("\t")
        elif child.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif child.tag in (W + "r", W + "hyperlink", W + "ins", W + "smartTag", W + "sdt", W + "sdtContent"):
            out.append(_text(child))
    return "".join(out)


def _runs(paragraph, styles: Styles) -> list[dict]:
    style = paragraph.find(f"{W}pPr/{W}pStyle")
    above = list(styles.chain(styles.fallback if style is None else style.get(W + "val")))
    out = []
    for run in paragraph.iter(W + "r"):
        text = _text(run)
        if not text:
            continue
        properties = run.find(W + "rPr")
        named = None if properties is None else properties.find(W + "rStyle")
        order = [_traits(properties), *(styles.chain(named.get(W + "val")) if named is not None else ()), *above, styles.default]
        first = lambda trait: next((t[trait] for t in order if t.get(trait) is not None), None)  # noqa: B023, E731
        fonts = sorted({f for t in order for f in t.get("fonts") or ()})
        out.append({"text": text, "fonts": fonts, "size_pt": first("size_pt"), "bold": bool(first("bold")), "italic": bool(first("italic"))})
    return out


def parse(content: bytes) -> Iterator[tuple[str, int, str, list[dict]]]:
    """(source, para_idx, text, runs) of a file: body paragraphs (blank ones too), then those of text boxes, then other parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        styles = Styles(archive.read("word/styles.xml") if "word/styles.xml" in names else None)
        root = ElementTree.fromstring(archive.read("word/document.xml"))
        body = root.find(W + "body")
        direct = [] if body is None else [p for p in body if p.tag == W + "p"]
        for n, p in enumerate(direct):
            yield BODY, n, _text(p), _runs(p, styles)
        boxes = [p for box in root.iter(W + "txbxContent") for p in box.iter(W + "p")]
        for n, p in enumerate(boxes):
            yield BOX, n, _text(p), []
        cells = [p for table in root.iter(W + "tbl") for p in table.iter(W + "p")]
        parts = [n for n in sorted(names) if re.fullmatch(r"word/(?:header|footer)\d*\.xml|word/(?:foot|end)notes\.xml", n)]
        rest = cells + [p for part in parts for p in ElementTree.fromstring(archive.read(part)).iter(W + "p")]
        for n, p in enumerate(rest):
            yield OTHER, n, _text(p), []


def article_paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, source, para_idx, text, runs, fault): paragraphs of ``article_files``. A file that can't be read gives one row with the fault."""

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            try:
                for source, n, text, runs in parse(r["content"]):
                    yield r["doc_id"], source, n, text, runs, None
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, TypeError) as fault:
                yield r["doc_id"], None, None, None, [], f"{type(fault).__name__}: {fault}"

    return arrow_pass(files.select("doc_id", "content"), rows, f"doc_id string, source string, para_idx int, text string, runs {RUNS}, fault string")


def full_text(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): all parts of a file, one paragraph a line, without byte order marks, vertical tabs and zero-width spaces."""
    place = F.when(F.col("source") == BODY, 0).when(F.col("source") == BOX, 1).otherwise(2)
    listed = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(place.alias("p"), "para_idx", "text"))))
    text = F.array_join(F.transform(listed, lambda s: s["text"]), "\n")
    return paragraphs.groupBy("doc_id").agg(F.regexp_replace(text, _DROPPED.pattern, "").alias("text"))


def headings(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, index, text): body paragraphs that the heading predicate takes."""
    from colophon.operators.citations import is_heading

    body = paragraphs.where((F.col("source") == BODY) & (F.trim("text") != ""))
    return body.where(is_heading(F.col("text"), F.col("runs"))).select("doc_id", F.col("para_idx").alias("index"), F.trim("text").alias("text"))
