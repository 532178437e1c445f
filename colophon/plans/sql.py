"""SQL of the core queries for DuckDB: the same results by other means."""

from __future__ import annotations

from colophon.functions.text import BLANK
from colophon.functions.vocab import values_sql


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def filled_sql(c: str) -> str:
    """Whether a cell holds anything but white space."""
    return f"coalesce(regexp_matches({c}, '[^{BLANK[1:]}'), false)"


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}+', ' ', 'g'))"


# records of the annotation sheet; the chain ends with r
RECORDS = f"""
with d as (select * from annotation_rows qualify row_number() over (partition by mention_id order by loaded_at nulls last) = 1),
b as (
  select mention_id, workbook, source_row, coalesce({strip_sql('lable')}, '') as label, coalesce({strip_sql('journal')}, '') as journal, year,
    nullif({strip_sql('self_citing_article')}, '') as title_anchor, nullif({strip_sql('self_cited_article')}, '') as cited_raw,
    coalesce({strip_sql('citation_content')}, '') as content, coalesce({strip_sql('citation_position')}, '') as position_raw,
    coalesce({strip_sql('citation_distance')}, '') as distance, citation_strength as strength_value,
    coalesce({strip_sql('citation_function')}, '') as function, coalesce({strip_sql('citation_depth')}, '') as depth, semantic_similarity as similarity
  from d),
r as (
  select mention_id, workbook, source_row, label, case when starts_with(label, 'G1') then 'G1' else 'G2' end as grp,
    case when contains(label, '-') then substring(label, instr(label, '-') + 1) else '' end as field, journal, year,
    workbook || '/A' || lpad(cast(count(title_anchor) over w as varchar), 4, '0') as article_id,
    last_value(title_anchor ignore nulls) over w as article_title, coalesce(title_anchor, '') as title_anchor,
    coalesce(cited_raw, '') as cited_raw, last_value(cited_raw ignore nulls) over w as cited, content,
    case when lower(position_raw) = 'discussion' then 'Discussion' else position_raw end as position, position_raw, distance,
    strength_value is not null as has_strength, count(strength_value) over w as anchor_no,
    case when strength_value is not null then workbook || '/S' || lpad(cast(count(strength_value) over w as varchar), 4, '0') else '' end as strength_id,
    strength_value, case when strength_value >= 5 then '>=5' when strength_value is not null then cast(cast(trunc(strength_value) as int) as varchar) end as strength,
    function, depth, similarity
  from b window w as (partition by workbook order by source_row rows between unbounded preceding and current row))
"""

# long: one row per record and dimension; vocab: the categories
LONG = RECORDS + f""",
long as (
  select 'position' as dim, position as category, grp, field, label, article_id from r union all
  select 'distance', distance, grp, field, label, article_id from r union all
  select 'function', function, grp, field, label, article_id from r union all
  select 'depth', depth, grp, field, label, article_id from r union all
  select 'strength', strength, grp, field, label, article_id from r where strength is not null),
vocab(dim, ord, category) as (values {values_sql()})
"""


def cells_sql(keys: str = "", source: str = "long") -> str:
    """Dense cells (keys, dim, ord, category, grp, n) over ``source``."""
    k = keys + ", " if keys else ""
    on = "".join(f" and c.{x.strip()} = f.{x.strip()}" for x in keys.split(",")) if keys else ""
    fk = "".join(f"f.{x.strip()}, " for x in keys.split(",")) if keys else ""
    return f"""select {fk}v.dim, v.ord, v.category, g.grp, coalesce(c.n, 0)::bigint as n
from (select distinct {k}dim from {source}) f join vocab v using (dim) cross join (values ('G1'), ('G2')) g(grp)
left join (select {k}dim, category, grp, count(*) as n from {source} group by all) c on c.dim = v.dim and c.category = v.category and c.grp = g.grp{on}"""


def erfc_sql(z: str) -> str:
    """Complementary error function of z >= 0: series below 2, else the continued fraction."""
    series = f"1 - 2 / sqrt(pi()) * list_sum([(-1) ** i * ({z}) ** (2 * i + 1) / (gamma(i + 1) * (2 * i + 1)) for i in range(60)])"
    fraction = f"exp(-({z}) * ({z})) / sqrt(pi()) / list_reduce(list_transform(range(200, 0, -1), lambda x: x::double), lambda f, i: ({z}) + i / 2 / f, ({z})::double)"
    return f"case when ({z}) < 2 then {series} else {fraction} end"


def tail_sql(x: str, df: str) -> str:
    """Upper tail of the chi-square distribution in closed form."""
    even = f"exp(-({x}) / 2) * list_sum([(({x}) / 2) ** i / gamma(i + 1) for i in range(({df}) // 2)])"
    odd = f"({erfc_sql(f'sqrt(({x}) / 2)')}) + exp(-({x}) / 2) * coalesce(list_sum([(({x}) / 2) ** (i - 0.5) / gamma(i + 0.5) for i in range(1, ({df}) // 2 + 1)]), 0)"
    return f"case when ({df}) < 1 then null when ({x}) <= 0 then 1.0 when ({df}) % 2 = 0 then {even} else {odd} end"


def chi_sql(cells: str, keys: str) -> str:
    """Chi-square tests (keys, chi2, df, p, v, n, expected_lt5, cells, min_expected) of the cells of each key."""
    return f"""
select {keys}, chi2, df, {tail_sql('chi2', 'df')} as p, sqrt(chi2 / n) as v, n, expected_lt5, cells, min_expected from (
  select {keys}, case when min(rt) > 0 and count(distinct category) > 1 then sum((n - e) ** 2 / e) end as chi2, count(distinct category) - 1 as df,
    max(nn)::bigint as n, count(*) filter (e < 5) as expected_lt5, count(*) as cells, min(e) as min_expected
  from (select *, rt * ct / nn as e from (
    select *, sum(n) over (partition by {keys}, category)::double as ct, sum(n) over (partition by {keys}, grp)::double as rt, sum(n) over (partition by {keys})::double as nn
    from ({cells})) where ct > 0)
  group by {keys})"""


def rounded_sql(tests: str, keys: str, extra: str = "") -> str:
    return f"""select {keys}, round(chi2, 6) as chi2, df::bigint as df, case when p > 0 then round(log10(p), 4) end as log10_p,
  round(v, 6) as cramers_v, n::bigint as n{', ' + extra if extra else ''} from ({tests})"""


def draw_sql(*parts: str) -> str:
    """Pseudorandom number of md5 of the parts."""
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::bigint"
