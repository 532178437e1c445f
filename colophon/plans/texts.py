"""Queries of the text operators over the documents and the annotation rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import chunks, citations, lines
from colophon.plans.runtime import cut_lineage, table
from colophon.plans.sql import squeeze_sql, strip_sql


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def _digest(df: DataFrame, c) -> DataFrame:
    return df.select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("digest"))


def normalize_text(spark, sf):
    return _digest(_documents(spark, sf), T.plain_characters(F.col("text")))


def clean_reference(spark, sf):
    rows = table(spark, sf, "annotation_rows").select("self_cited_article").distinct()
    return rows.select("self_cited_article", T.clean_reference(F.col("self_cited_article")).alias("cleaned"))


def clean_context(spark, sf):
    return _digest(_documents(spark, sf), T.clean_context(F.col("text")))


def dehyphenate(spark, sf):
    return _digest(_documents(spark, sf), T.rejoin_hyphens(F.col("text")))


def compare_key(spark, sf):
    return _digest(_documents(spark, sf), T.compare_key(F.col("text")))


def cell_text(spark, sf):
    return table(spark, sf, "test_set").select(
        "record_id", *[T.cell_text(F.col(c)).alias(c) for c in ("self_cited_article_title", "citation_content", "citation_location", "citation_function")]
    )


def quality_flags(spark, sf):
    c = F.col("text")
    return _documents(spark, sf).select(
        "doc_id", F.length(T.clean_context(c)).cast("long").alias("clean_chars"), T.dash_count(c).cast("long").alias("dashes"),
        T.year_count(c).cast("long").alias("years"), T.context_flag(c).alias("flag"),
    )


def flag_counts(spark, sf):
    rows = table(spark, sf, "annotation_rows").select("workbook", "citation_content")
    return rows.groupBy("workbook", T.context_flag(F.coalesce("citation_content", F.lit(""))).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def first_letter_class(spark, sf):
    return _documents(spark, sf).select("doc_id", T.starts_upper(F.col("text")).alias("starts_upper"))


def paren_depth(spark, sf):
    p = T.paren_profile(F.col("text"))
    return _documents(spark, sf).where("text is not null").select("doc_id", p["deepest"].cast("long").alias("deepest"), p["open_at_end"].cast("long").alias("open_at_end"))


def line_split(spark, sf):
    return lines.split_lines(_documents(spark, sf), "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def line_merge_islands(spark, sf):
    merged = lines.merge_entries(lines.split_lines(_documents(spark, sf), "doc_id", "text"), "doc_id")
    return merged.select("doc_id", F.col("entry_no").cast("long").alias("entry_no"), F.md5("entry").alias("digest"))


def _paragraphs(spark, sf) -> DataFrame:
    return lines.split_lines(_documents(spark, sf), "doc_id", "text").select("doc_id", F.col("line_no").alias("para_idx"), F.col("line").alias("text"))


def body_paragraphs(spark, sf):
    return citations.body_paragraphs(_paragraphs(spark, sf)).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.md5("text").alias("digest"))


def _index(spark, sf) -> DataFrame:
    return citations.sentence_index(_paragraphs(spark, sf))


def sentence_split_basic(spark, sf):
    return _index(spark, sf).select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), F.col("para_idx").cast("long").alias("para_idx"), "sent")


def sentence_context_pm3(spark, sf):
    return citations.context(_index(spark, sf)).select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), F.md5("context").alias("digest"))


def context_lookup_first_match(spark, sf):
    """Each sentence in lower case and without spaces finds the first sentence of its document that reads alike."""
    index = cut_lineage(_index(spark, sf))
    wanted = index.select("doc_id", F.lower(F.regexp_replace("sent", T.BLANK + "+", "")).alias("sentence")).distinct()
    return citations.lookup_sentence(index, wanted).select("doc_id", "sentence", F.col("sent_pos").cast("long").alias("sent_pos"))


def linked_context(spark, sf):
    return citations.linked_context(_index(spark, sf)).select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), F.md5("linked_context").alias("digest"))


def linked_context_fallbacks(spark, sf):
    """Sentences, and how many of them come out of the context rule as they were."""
    return citations.linked_context(_index(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("linked_context") == F.col("sent")).alias("unchanged"))


def heading_candidates(spark, sf):
    return _paragraphs(spark, sf).where(citations.heading_text(F.col("text"))).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "text")


def section_asof(spark, sf):
    rows = cut_lineage(_paragraphs(spark, sf))
    headings = rows.where(citations.heading_text(F.col("text"))).select("doc_id", F.col("para_idx").alias("index"), "text")
    return citations.sections(rows.select("doc_id", "para_idx"), headings).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "section_name")


def stop_lines(spark, sf):
    return _paragraphs(spark, sf).where(citations.stop_line(F.col("text"))).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"))


def abstract_extract(spark, sf):
    """Abstracts of the documents, their lines as paragraphs."""
    return citations.abstracts(_paragraphs(spark, sf).withColumn("source", F.lit("body")))


def chunk_pack(spark, sf):
    out = chunks.text_chunks(_documents(spark, sf), "doc_id", "text")
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("digest"))


QUERIES = [
    normalize_text, clean_reference, clean_context, dehyphenate, compare_key, cell_text, quality_flags, flag_counts, first_letter_class, paren_depth, line_split,
    line_merge_islands, body_paragraphs, sentence_split_basic, sentence_context_pm3, context_lookup_first_match, linked_context, linked_context_fallbacks,
    heading_candidates, section_asof, stop_lines, abstract_extract, chunk_pack,
]


def _plain_sql(c: str) -> str:
    out = f"translate({c}, '（）{T.SPACES}{T.REMOVED}', '(){' ' * len(T.SPACES)}')"
    for a, b in T.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _digest_sql(c: str) -> str:
    return f"select doc_id, length({c}) as n_chars, md5({c}) as digest from documents"


def _context_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{T.BLANK}+', ' ', 'g'), '[-–—]{{2,}}', ' ', 'g'))"


def _key_sql(c: str) -> str:
    return f"lower(regexp_replace({_plain_sql(c)}, '{T.BLANK}+', '', 'g'))"


def _hyphen_sql(c: str) -> str:
    return rf"regexp_replace({c}, '([\p{{L}}\p{{N}}_])[\-\x{{2010}}-\x{{2014}}]\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g')"


def _years_sql(c: str) -> str:
    """Distinct year words: every other sign becomes two spaces, so that neighbours don't share one."""
    return rf"len(list_distinct(regexp_extract_all(' ' || regexp_replace({c}, '[^\p{{L}}\p{{N}}_]', '  ', 'g') || ' ', ' ((?:19|20)[0-9]{{2}}[a-z]?) ', 1)))"


def _dashes_sql(c: str) -> str:
    return f"(length({c}) - length(translate({c}, '-–—', '')))"


def _flag_sql(c: str) -> str:
    return f"case when length({_context_sql(c)}) < {T.SHORT} then 'short' when {_dashes_sql(c)} > {T.DASHES} then 'dashes' when {_years_sql(c)} > 1 then 'years' else '' end"


LINES = rf"""with parts as (select doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) as line, unnest(range(1, len(string_split_regex(text, '\r\n|\r|\n')) + 1)) as line_no from documents),
ln as (select doc_id, line_no, {strip_sql('line')} as line from parts where {strip_sql('line')} <> '')
"""
# one row per sign of a line, with the depth of parentheses around it; the chain ends with sents(doc_id, sent_pos, para_idx, sent)
SENTENCES = LINES + rf""",
ch as (select doc_id, line_no, unnest(range(1, length(line) + 1)) as i, line from ln),
cs as (select doc_id, line_no, i, substring(line, i, 1) as c, substring(line, i + 1, 1) as nx, lower(substring(line, greatest(1, i - 5), i - greatest(1, i - 5) + 1)) as tail from ch),
rs as (select *, sum(case c when '(' then 1 when ')' then -1 else 0 end) over (partition by doc_id, line_no order by i) as s from cs),
ds as (select *, s - least(0, min(s) over (partition by doc_id, line_no order by i)) as depth from rs),
bd as (select *, case when c in ('。', '！', '？', '.', '!', '?') and depth = 0 and not (c = '.' and nx = ',') and tail <> 'et al.' then 1 else 0 end as cut from ds),
sg as (select *, coalesce(sum(cut) over (partition by doc_id, line_no order by i rows between unbounded preceding and 1 preceding), 0) as seg from bd),
ss as (select doc_id, line_no, seg, {strip_sql("string_agg(c, '' order by i)")} as sent from sg group by all),
sents as (select doc_id, row_number() over (partition by doc_id order by line_no, seg) as sent_pos, line_no as para_idx, sent from ss where sent <> '')
"""
_HEADING = r"""(len(regexp_extract_all(line, '([A-Za-z][A-Za-z0-9\-/]*)')) between 1 and 5 and regexp_matches(regexp_extract(line, '([A-Za-z][A-Za-z0-9\-/]*)', 1), '^[A-Z]')
  and trim(regexp_replace(lower(trim(line)), '\.+$', '')) not in ('abstract', 'keywords', 'key words', 'references'))"""
_STOP = r"""((len(regexp_extract_all(line, '([A-Za-z]+)')) between 1 and 6 and length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) / nullif(length(regexp_replace(line, '[^\p{L}]', '', 'g')), 0) > 0.8)
  or """ + " or ".join(f"regexp_matches(line, '{p}')" for p in citations._STOP) + ")"
_LINKED = r"""lk as (select *, regexp_matches(sent, '(?i)^\W*(?:however|moreover|furthermore|therefore|thus|hence|similarly|in addition|in contrast|this|that|these|those|such|it|its|they|their|he|she|we|us|our)\b') as l from sents),
lc as (select doc_id, sent_pos, sent, concat_ws(' ', case when l then lag(sent) over w end, sent, case when lead(l) over w then lead(sent) over w end) as ctx from lk window w as (partition by doc_id order by sent_pos))
"""

_SPACED = r"(?i)^\s*" + r"\s*[\W_]*".join("abstract") + r"\s*:?\s*$"
_WAYS = ("inline", "after", "loose")


def _collected_sql(way: str) -> str:
    """Lines of one way from its first to before its stop line, joined; the first one only for the inline way."""
    inside = f"line_no > from_{way} and (to_{way} is null or line_no < to_{way})"
    kept = rf"not regexp_matches(line, '^[-=_·•\x{{2500}}\x{{2014}}\x{{2015}}\x{{2212}}\s]+$') and {inside}" if way == "after" else inside
    piece = f"case when {kept} then {_hyphen_sql('line')} end"
    if way == "inline":
        head = rf"nullif(trim({_hyphen_sql('regexp_replace(line, ' + chr(39) + '(?i)^' + chr(92) + 's*abstract' + chr(92) + 's*:?' + chr(92) + 's*' + chr(39) + ', ' + chr(39) * 2 + ')')}), '')"
        piece = f"case when line_no = from_inline then {head} else {piece} end"
    return f"nullif(trim(string_agg({piece}, ' ' order by line_no)), '') as {way}"


_ABSTRACTS = LINES + rf""", ab as (select doc_id, line_no, {squeeze_sql(_plain_sql('line'))} as line from ln),
fl as (select *, regexp_matches(line, '(?i)^\s*abstract\s*:?\s*') as is_inline, lower(line) = 'abstract' or regexp_matches(line, '{_SPACED}') as is_after,
  contains(lower(line), 'abstract') or regexp_matches(line, '{_SPACED}') as is_loose, {_STOP} as stop from ab where line <> ''),
fr as (select *, {', '.join(f'min(line_no) filter (is_{w}) over (partition by doc_id) as from_{w}' for w in _WAYS)} from fl),
st as (select *, {', '.join(f'min(line_no) filter (stop and line_no > from_{w}) over (partition by doc_id) as to_{w}' for w in _WAYS)} from fr),
pc as (select doc_id, {', '.join(_collected_sql(w) for w in _WAYS)} from st group by doc_id)
select doc_id, coalesce(inline, after, loose, '') as abstract from pc"""

ORACLE = {
    "abstract_extract": _ABSTRACTS,
    "normalize_text": _digest_sql(_plain_sql("text")),
    "clean_reference": f"select distinct self_cited_article, {squeeze_sql(_plain_sql('self_cited_article'))} as cleaned from annotation_rows",
    "clean_context": _digest_sql(_context_sql("text")),
    "dehyphenate": _digest_sql(_hyphen_sql("text")),
    "compare_key": _digest_sql(_key_sql("text")),
    "cell_text": "select record_id, " + ", ".join(
        f"coalesce({squeeze_sql(c)}, '') as {c}" for c in ("self_cited_article_title", "citation_content", "citation_location", "citation_function")) + " from test_set",
    "quality_flags": f"select doc_id, length({_context_sql('text')}) as clean_chars, {_dashes_sql('text')} as dashes, {_years_sql('text')}::bigint as years, {_flag_sql('text')} as flag from documents",
    "flag_counts": f"select workbook, {_flag_sql('c')} as flag, count(*) as n from (select workbook, coalesce(citation_content, '') as c from annotation_rows) group by all",
    "first_letter_class": r"""select doc_id, f <> '' and upper(f) = f and lower(f) <> f as starts_upper from (select doc_id, regexp_extract(text, '\p{L}', 0) as f from documents)""",
    "paren_depth": """with p as (select doc_id, unnest(regexp_extract_all(text, '[()]')) as c, unnest(range(len(regexp_extract_all(text, '[()]')))) as i from documents),
s as (select *, sum(case c when '(' then 1 else -1 end) over (partition by doc_id order by i) as s from p),
d as (select *, s - least(0, min(s) over (partition by doc_id order by i)) as depth from s)
select doc_id, coalesce(max(depth), 0)::bigint as deepest, coalesce(arg_max(depth, i), 0)::bigint as open_at_end from documents left join d using (doc_id) where text is not null group by doc_id""",
    "line_split": LINES + "select doc_id, line_no, line from ln",
    "line_merge_islands": LINES + rf""", m as (select *, sum((regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])(?:19|20)\d{{2}}[a-z]?($|[^\p{{L}}\p{{N}}_])') and f <> '' and upper(f) = f and lower(f) <> f
  and not regexp_matches(line, '^\(?\d{{1,3}}[\).]?\s+'))::int) over (partition by doc_id order by line_no) as entry_no from (select *, regexp_extract(line, '\p{{L}}', 0) as f from ln))
select doc_id, entry_no::bigint as entry_no, md5(string_agg(line, ' ' order by line_no)) as digest from m group by all""",
    "body_paragraphs": LINES + f""", b as (select doc_id, line_no, {strip_sql(_plain_sql('line'))} as t from ln), s as (select *, min(line_no) filter (lower(t) = 'references') over (partition by doc_id) as stop from b)
select doc_id, line_no as para_idx, md5({_hyphen_sql('t')}) as digest from s where (stop is null or line_no < stop) and {_hyphen_sql('t')} <> ''""",
    "sentence_split_basic": SENTENCES + "select doc_id, sent_pos, para_idx, sent from sents",
    "sentence_context_pm3": SENTENCES + "select doc_id, sent_pos, md5(string_agg(sent, ' ') over (partition by doc_id order by sent_pos rows between 3 preceding and 3 following)) as digest from sents",
    "context_lookup_first_match": SENTENCES + f""", w as (select distinct doc_id, lower(regexp_replace(sent, '{T.BLANK}+', '', 'g')) as sentence from sents),
f as (select doc_id, {_key_sql('sent')} as k, min(sent_pos) as sent_pos from sents group by all)
select w.doc_id, w.sentence, f.sent_pos from w left join f on f.doc_id = w.doc_id and f.k = {_key_sql('w.sentence')}""",
    "linked_context": SENTENCES + ", " + _LINKED + "select doc_id, sent_pos, md5(ctx) as digest from lc",
    "linked_context_fallbacks": SENTENCES + ", " + _LINKED + "select count(*) as n, count(*) filter (ctx = sent) as unchanged from lc",
    "heading_candidates": LINES + f"select doc_id, line_no as para_idx, line as text from ln where {_HEADING}",
    "section_asof": LINES + f""", h as (select doc_id, line_no, line from ln where {_HEADING})
select ln.doc_id, ln.line_no as para_idx, coalesce(h.line, 'Unknown') as section_name from ln asof left join h on ln.doc_id = h.doc_id and ln.line_no >= h.line_no""",
    "stop_lines": LINES + f"select doc_id, line_no as para_idx from ln where {_STOP}",
    "chunk_pack": rf"""with recursive u as (
  select doc_id, text, case when len(s) > 1 then '. ' else ' ' end as glue, case when len(s) > 1 then '.' else '' end as fin, case when len(s) > 1 then s else regexp_extract_all(text, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+') end as units
  from (select doc_id, text, string_split(text, '. ') as s from documents where text is not null)),
n as (select doc_id, unnest(units) as unit, unnest(range(1, len(units) + 1)) as i from u),
z as (select doc_id, i, len(regexp_extract_all(unit, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) as size, unit from n),
w as (select doc_id, i, size, 0::bigint as chunk, size as used from z where i = 1 union all
  select z.doc_id, z.i, z.size, case when w.used + z.size > {chunks.CHUNK_TOKENS} then w.chunk + 1 else w.chunk end, case when w.used + z.size > {chunks.CHUNK_TOKENS} then z.size else w.used + z.size end
  from w join z on z.doc_id = w.doc_id and z.i = w.i + 1),
g0 as (select u.doc_id, chunk as chunk_no, list(z.unit order by z.i) as us, max(glue) as glue, max(fin) as fin
  from w join z using (doc_id, i) join u using (doc_id) group by u.doc_id, chunk),
g as (select doc_id, chunk_no, max(chunk_no) over (partition by doc_id) as last, list_reduce(us, lambda a, b: a || glue || b) as body, fin from g0)
select doc_id, chunk_no, md5(case when chunk_no < last or not ends_with(body, fin) then body || fin else body end) as digest from g
union all select doc_id, 0, md5(text[1:{chunks.FALLBACK}]) from u where len(units) = 0""",
}
