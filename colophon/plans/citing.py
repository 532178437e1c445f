"""Queries of the reference and mention operators, and their SQL.

A workbook is a document: its citation contents are the paragraphs (numbered by sheet row), its distinct
self-cited entries the references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import BLANK
from colophon.operators import citations, lines, records
from colophon.plans.runtime import cut_lineage, table
from colophon.plans.sql import RECORDS, squeeze_sql, strip_sql
from colophon.plans.texts import _plain_sql

#: Year of the target references in the queries, and journals of the loose journal pattern.
TARGET_YEAR = 2015


def _records(spark, sf) -> DataFrame:
    return records.analysis_records(table(spark, sf, "annotation_rows"))


def _entries(spark, sf) -> DataFrame:
    """(doc_id, ref_order, ref_text): distinct entries of a workbook in the order of their first row."""
    found = _records(spark, sf).where("cited is not null").groupBy(F.col("workbook").alias("doc_id"), F.col("cited").alias("ref_text")).agg(F.min("source_row").alias("at"))
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "ref_text")).alias("ref_order"), "ref_text")


def _journals(spark, sf) -> list[str]:
    # ten rows, a fixed list
    return [r["journal"] for r in table(spark, sf, "journals").select("journal").orderBy("label").collect()]


def author_year_parse(spark, sf):
    return _entries(spark, sf).select(
        "doc_id", "ref_text", lines.first_author(F.col("ref_text")).alias("surname"), lines.entry_year(F.col("ref_text")).cast("long").alias("ref_year")
    )


def journal_year_filter(spark, sf):
    found = lines.target_references(_entries(spark, sf), _journals(spark, sf), TARGET_YEAR)
    return found.select("doc_id", "ref_text", "surname", F.col("ref_year").cast("long").alias("ref_year"))


def target_year_default(spark, sf):
    """First author and year of each entry; the target year where an entry has none."""
    found = lines.with_author_year(_entries(spark, sf), TARGET_YEAR)
    return found.groupBy("ref_year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("surname") == "").alias("without_author")).select(
        F.col("ref_year").cast("long").alias("ref_year"), "n", "without_author"
    )


def _listed(spark, sf) -> DataFrame:
    """(doc_id, text): a workbook's article with its reference list, entries broken over two lines."""
    entries = _entries(spark, sf).withColumn("e", F.replace(F.col("ref_text"), F.lit(": "), F.lit(":\n")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_order", "e"))), lambda s: s["e"]), "\n")
    return entries.groupBy("doc_id").agg(F.concat(F.lit("Main text, see References below\n\n References \n"), listed, F.lit("\nFunding\nNone 2015")).alias("text"))


def reference_block(spark, sf):
    return _listed(spark, sf).select("doc_id", F.md5(lines.reference_block(F.col("text"))).alias("digest"))


def reference_entries(spark, sf):
    return lines.reference_entries(_listed(spark, sf), "doc_id", "text").select("doc_id", F.col("ref_order").cast("long").alias("ref_order"), "ref_text")


def _found(spark, sf) -> DataFrame:
    """Mentions of a workbook's entries in its citation contents."""
    rows = _records(spark, sf).select(F.col("workbook").alias("doc_id"), F.col("source_row").alias("para_idx"), F.col("content").alias("text"))
    targets = lines.with_author_year(_entries(spark, sf), TARGET_YEAR)
    return citations.mentions(citations.body_paragraphs(rows), targets)


def citation_match(spark, sf):
    return citations.hits(_found(spark, sf)).select(
        "doc_id", F.col("para_idx").cast("long").alias("para_idx"), "sentence", F.array_join("matched", " | ").alias("matched"), F.col("first_at").cast("long").alias("first_at")
    )


def mention_strength(spark, sf):
    """Strength of the entries in the matched sentences."""
    return citations.strength(_found(spark, sf)).groupBy("doc_id", "ref_text").agg(F.max("strength").alias("strength"))


def annotate(spark, sf):
    """From paragraphs to mention rows: match, strength, placeholders, section, de-duplication, context, distance."""
    rows = cut_lineage(_records(spark, sf))
    paragraphs = rows.select(F.col("workbook").alias("doc_id"), F.col("source_row").alias("para_idx"), F.col("content").alias("text"))
    headings = rows.select(F.col("workbook").alias("doc_id"), F.col("source_row").alias("index"), F.col("position").alias("text"))
    out = citations.annotate(paragraphs, lines.with_author_year(_entries(spark, sf), TARGET_YEAR), headings)
    return out.select("doc_id", "ref_text", "sentence", F.col("para_idx").cast("long").alias("para_idx"), "strength", "section_name", "distance", F.md5("context").alias("context"))


def _rows(spark, sf) -> DataFrame:
    """Rows (row_id, doc_id, ref_text, sentence, para_idx, section_name) of the sheets, as if they were matched mentions."""
    return _records(spark, sf).where("cited is not null").select(
        F.col("mention_id").alias("row_id"), F.col("workbook").alias("doc_id"), F.col("cited").alias("ref_text"), F.col("content").alias("sentence"),
        (F.col("source_row") / 3).cast("int").alias("para_idx"), F.col("position").alias("section_name"),
    )


def citation_strength(spark, sf):
    out = citations.strength(_rows(spark, sf))
    return out.select("doc_id", "ref_text", F.md5("sentence").alias("sentence"), F.col("para_idx").cast("long").alias("para_idx"), "strength", "strength_max").distinct()


def citation_distance(spark, sf):
    return citations.distance(_rows(spark, sf)).select("row_id", "distance")


def distance_self_join(spark, sf):
    return citations.distance_by_join(_rows(spark, sf)).select("row_id", "distance")


def _targets(spark, sf) -> DataFrame:
    return _entries(spark, sf)


def ref_semi_join(spark, sf):
    """Rows whose entry is a target of the year."""
    wanted = lines.target_references(_entries(spark, sf), _journals(spark, sf), TARGET_YEAR).select("doc_id", "ref_text")
    return _rows(spark, sf).join(wanted, ["doc_id", "ref_text"], "left_semi").select("row_id")


def ref_order_lookup(spark, sf):
    """Order of each row's entry; the default for entries that aren't listed."""
    wanted = lines.target_references(_entries(spark, sf), _journals(spark, sf), TARGET_YEAR).select("doc_id", "ref_text", "ref_order")
    return citations.with_ref_order(_rows(spark, sf), wanted).select("row_id", F.col("ref_order").cast("long").alias("ref_order"))


def _placed(spark, sf) -> DataFrame:
    rows = _rows(spark, sf).where("sentence <> ''").select("doc_id", "ref_text", "sentence", "para_idx")
    return citations.first_per_sentence(citations.with_placeholders(_targets(spark, sf), rows))


def placeholder_union(spark, sf):
    """One row per entry and sentence, and a placeholder for each entry without a sentence."""
    return _placed(spark, sf).select("doc_id", "ref_text", F.md5("sentence").alias("sentence"), F.col("para_idx").cast("long").alias("para_idx"))


def final_order(spark, sf):
    return citations.final_order(_placed(spark, sf)).select("doc_id", "ref_text", F.md5("sentence").alias("sentence"), F.col("position").cast("long").alias("position"))


def first_n_rows(spark, sf):
    """The first five rows of each sheet, before blank ones are skipped."""
    rows = records.first_delivery(table(spark, sf, "annotation_rows"))
    return records.first_rows(rows, 5).select("workbook", "source_row", "mention_id")


def blank_row_skip(spark, sf):
    """Rows of a sheet that hold anything in the three text columns."""
    filled = F.exists(F.array("self_citing_article", "self_cited_article", "citation_content"), lambda x: F.coalesce(x.rlike(f"[^{BLANK[1:]}"), F.lit(False)))
    return table(spark, sf, "annotation_rows").where(filled).groupBy("workbook").agg(F.count(F.lit(1)).alias("n"))


QUERIES = [
    author_year_parse, journal_year_filter, target_year_default, reference_block, reference_entries, citation_match, mention_strength, annotate,
    citation_strength, citation_distance, distance_self_join, ref_semi_join, ref_order_lookup, placeholder_union, final_order, first_n_rows, blank_row_skip,
]

_NAME = r"\p{L}[\p{L}\p{M}''\x{2019} \-\x{2010}-\x{2015}]*"
_AUTHOR = rf"""case when instr(c, ',') > 0 and regexp_matches({strip_sql("split_part(c, ',', 1)")}, '^{_NAME}$') then {strip_sql("split_part(c, ',', 1)")}
  else regexp_replace(regexp_extract(regexp_replace(c, '(?s)\((?:19|20)[0-9]{{2}}[a-z]?\).*$', ''), '{_NAME}', 0), '[^\p{{L}}\p{{M}}]+$', '') end"""
_YEAR = r"""coalesce(nullif(regexp_extract(c, '\(((?:19|20)[0-9]{2})[a-z]?\)', 1), ''), nullif(regexp_extract(' ' || regexp_replace(c, '[^\p{L}\p{N}_]+', ' ', 'g') || ' ', ' ((?:19|20)[0-9]{2})[a-z]? ', 1), ''), '-1')::bigint"""
ENTRIES = RECORDS + f""",
en as (select doc_id, ref_text, row_number() over (partition by doc_id order by first_row, ref_text) as ref_order from
  (select workbook as doc_id, cited as ref_text, min(source_row) as first_row from r where cited is not null group by all)),
ay as (select doc_id, ref_order, ref_text, {_AUTHOR.replace('(c', '(ref_text')} as surname, {_YEAR.replace('(c', '(ref_text')} as ref_year from en)
"""
# journals whose letters stand in order, white space and hyphens between them, up to 60 signs between words
TARGETS = ENTRIES + rf""", jp as (select '(?i)' || string_agg(regexp_replace(regexp_replace(journal, '([^ ])', '[\1][\\s\\x{{a0}}\\x{{202f}}\\x{{2009}}\\x{{2007}}\\x{{2002}}-\\x{{2006}}\\x{{ad}}\\x{{200b}}\\-]*', 'g'), ' ', '[^\\n]{{0,60}}?', 'g'), '|') as p from journals),
tg as (select doc_id, ref_order, ref_text, surname, case when ref_year = -1 then {TARGET_YEAR} else ref_year end as ref_year from ay, jp
  where regexp_matches(ref_text, p) and regexp_matches(' ' || regexp_replace(ref_text, '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ', ' {TARGET_YEAR}[a-z]? '))
"""
ROWS = ENTRIES + """, rw as (select mention_id as row_id, workbook as doc_id, cited as ref_text, content as sentence, source_row // 3 as para_idx, position as section_name from r where cited is not null)
"""
_LISTED = ENTRIES + r""", tx as (select doc_id, 'Main text, see References below' || chr(10) || chr(10) || ' References ' || chr(10) || string_agg(replace(ref_text, ': ', ':' || chr(10)), chr(10) order by ref_order)
  || chr(10) || 'Funding' || chr(10) || 'None 2015' as text from en group by doc_id),
bl as (select doc_id, string_split_regex(regexp_extract(regexp_replace(""" + _plain_sql("text") + r""", '[\x{feff}\x{0b}]', '', 'g'), '(?im)^[^A-Za-z\n]*References[^A-Za-z\n]*$((?s).*)', 1), '(?im)^\s*(?:Appendix|Acknowledg|Funding|About the author|作者简介|附录)([^\p{L}\p{N}_]|$)')[1] as block from tx)
"""
_DISTANCE = """select row_id, case when min(ref_text) over d = max(ref_text) over d then 'only one self-citation' when s = '' then 'DifferentSection'
  when min(ref_text) over (partition by doc_id, s) <> max(ref_text) over (partition by doc_id, s) then 'SameSentence'
  when para_idx <> -1 and min(ref_text) over (partition by doc_id, para_idx) <> max(ref_text) over (partition by doc_id, para_idx) then 'SameParagraph'
  when section_name <> '' and min(ref_text) over (partition by doc_id, section_name) <> max(ref_text) over (partition by doc_id, section_name) then 'SameSection'
  else 'DifferentSection' end as distance from (select *, trim(sentence) as s from rw) window d as (partition by doc_id)"""
_JOINED = """select a.row_id, case when count(b.row_id) = 0 then 'only one self-citation' when any_value(trim(a.sentence)) = '' then 'DifferentSection'
  else list_extract(['SameSentence', 'SameParagraph', 'SameSection', 'DifferentSection'], 1 + min(case when trim(a.sentence) = trim(b.sentence) then 0
    when a.para_idx <> -1 and a.para_idx = b.para_idx then 1 when a.section_name <> '' and a.section_name = b.section_name then 2 else 3 end)) end as distance
from rw a left join rw b on a.doc_id = b.doc_id and a.ref_text <> b.ref_text group by a.row_id"""
PLACED = ROWS + """, pl as (select doc_id, ref_text, sentence, min(para_idx) as para_idx from rw where sentence <> '' group by all
  union all select doc_id, ref_text, '', -1 from en e where not exists (select 1 from rw where rw.doc_id = e.doc_id and rw.ref_text = e.ref_text and sentence <> ''))
"""

ORACLE = {
    "author_year_parse": ENTRIES + "select doc_id, ref_text, surname, ref_year from ay",
    "journal_year_filter": TARGETS + "select doc_id, ref_text, surname, ref_year from tg",
    "target_year_default": ENTRIES + f"select case when ref_year = -1 then {TARGET_YEAR} else ref_year end as ref_year, count(*) as n, count(*) filter (surname = '') as without_author from ay group by 1",
    "reference_block": _LISTED + "select doc_id, md5(block) as digest from bl",
    "reference_entries": _LISTED + rf""", lp as (select doc_id, unnest(string_split(block, chr(10))) as line, unnest(range(len(string_split(block, chr(10))))) as i from bl),
lm as (select doc_id, i, {strip_sql('line')} as line from lp where {strip_sql('line')} <> ''),
mk as (select *, sum((regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])(?:19|20)\d{{2}}[a-z]?($|[^\p{{L}}\p{{N}}_])') and f <> '' and upper(f) = f and lower(f) <> f
  and not regexp_matches(line, '^\(?\d{{1,3}}[\).]?\s+'))::int) over (partition by doc_id order by i) as g from (select *, regexp_extract(line, '\p{{L}}', 0) as f from lm))
select doc_id, row_number() over (partition by doc_id order by g) as ref_order, {squeeze_sql(_plain_sql('entry'))} as ref_text from (select doc_id, g, string_agg(line, ' ' order by i) as entry from mk group by all)""",
    "citation_strength": ROWS + """, di as (select distinct doc_id, ref_text, sentence, para_idx from rw), st as (select *, count(*) over (partition by doc_id, ref_text) as strength from di)
select doc_id, ref_text, md5(sentence) as sentence, para_idx::bigint as para_idx, strength, max(strength) over (partition by doc_id, para_idx, sentence) as strength_max from st""",
    # each query has the other one's form as its check
    "citation_distance": ROWS + _JOINED,
    "distance_self_join": ROWS + _DISTANCE,
    "ref_semi_join": TARGETS + ", rw as (select mention_id as row_id, workbook as doc_id, cited as ref_text from r) select row_id from rw semi join tg using (doc_id, ref_text)",
    "ref_order_lookup": TARGETS + """, rw as (select mention_id as row_id, workbook as doc_id, cited as ref_text from r where cited is not null)
select row_id, coalesce(ref_order, 1000000000)::bigint as ref_order from rw left join tg using (doc_id, ref_text)""",
    "placeholder_union": PLACED + "select doc_id, ref_text, md5(sentence) as sentence, para_idx::bigint as para_idx from pl",
    "final_order": PLACED + """select doc_id, ref_text, md5(sentence) as sentence, row_number() over (partition by doc_id order by ref_order, case when para_idx = -1 then 1000000000 else para_idx end, sentence) as position
from pl join en using (doc_id, ref_text)""",
    "first_n_rows": """select workbook, source_row, mention_id from (select * from annotation_rows qualify row_number() over (partition by mention_id order by loaded_at nulls last) = 1)
qualify row_number() over (partition by workbook order by source_row) <= 5""",
    "blank_row_skip": f"select workbook, count(*) as n from annotation_rows where regexp_matches(concat_ws('', self_citing_article, self_cited_article, citation_content), '[^{BLANK[1:]}') group by workbook",
}
