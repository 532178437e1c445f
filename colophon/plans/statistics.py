"""Queries of the statistics over the annotation rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions.vocab import DEPTH, DISPLAY, FUNCTION, HYPOTHESES, LABELS
from colophon.operators import clusters, contingency, multitest, quality, ranks, records
from colophon.plans.runtime import cut_lineage, table
from colophon.plans.sql import LONG, RECORDS, cells_sql, chi_sql, draw_sql, erfc_sql, filled_sql, rounded_sql, strip_sql

#: Iterations of the bootstrap with md5 draws, and of the Monte-Carlo test.
BOOTSTRAPS, TABLES = 100, 10_000


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return records.analysis_records(table(spark, sf, "annotation_rows"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return contingency.counts_for_tests(_records(spark, sf))


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    """(dim, p) of the six tests: five tables and the rank test of the similarity."""
    rows = cut_lineage(_records(spark, sf))
    tables = contingency.chi_square(contingency.dense(contingency.counts_for_tests(rows)), ["dim"]).select("dim", "p")
    return tables.unionAll(ranks.mann_whitney(rows, "grp", "similarity").select(F.lit("similarity").alias("dim"), "p"))


def mentions_projection(spark, sf):
    """The records that all statistics read."""
    return records.with_field_names(_records(spark, sf), table(spark, sf, "journals")).select(
        "mention_id", "workbook", "source_row", "label", "grp", "field", "field_name", "journal", "article_id", "position", "distance", "strength", "function", "depth",
        F.round("similarity", 6).alias("similarity"),
    )


def forward_fill_ids(spark, sf):
    return _records(spark, sf).select("mention_id", "article_title", "cited", "article_id", "strength_id", F.col("anchor_no").cast("long").alias("anchor_no"))


def article_runs(spark, sf):
    """Rows of each run of an article: from one title cell to the next."""
    return _records(spark, sf).groupBy("workbook", "article_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"), F.max("title_anchor").alias("title")
    )


def category_counts_dense(spark, sf):
    return contingency.dense(_counts(spark, sf)).select("dim", "ord", "category", "grp", F.col("n").cast("long").alias("n"))


def category_percentages(spark, sf):
    return contingency.percentages(contingency.dense(_counts(spark, sf))).select("dim", "category", "grp", "share")


def chi_square_aggregate(spark, sf):
    return contingency.rounded(contingency.chi_square(contingency.dense(_counts(spark, sf)), ["dim"]), ["dim"])


def chi_square_by_field(spark, sf):
    return contingency.rounded(contingency.chi_square(contingency.dense(_counts(spark, sf), ["field"]), ["field", "dim"]), ["field", "dim"])


def chi_square_expected_diag(spark, sf):
    """Cells of small expectation in the tests of each field."""
    tests = contingency.chi_square(contingency.dense(_counts(spark, sf), ["field"]), ["field", "dim"])
    return tests.select("field", "dim", F.col("expected_lt5").cast("long").alias("expected_lt5"), F.col("cells").cast("long").alias("cells"), F.round("min_expected", 6).alias("min_expected"))


def chi_square_odd_df(spark, sf):
    """Tests without the first category of each dimension: odd degrees of freedom in most."""
    cells = contingency.dense(_counts(spark, sf)).where("ord > 1")
    return contingency.rounded(contingency.chi_square(cells, ["dim"]), ["dim"])


def chi_square_grouping_sets(spark, sf):
    """Tests over all records and per field from one set of counts."""
    counts = _counts(spark, sf)
    scopes = counts.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat(F.lit("field "), F.col("field")))))
    return contingency.rounded(contingency.chi_square(contingency.dense(scopes, ["scope"]), ["scope", "dim"]), ["scope", "dim"])


def leave_one_label_out(spark, sf):
    return contingency.rounded(contingency.leave_one_out(_counts(spark, sf)), ["excluded", "dim"])


def binary_collapse_sensitivity(spark, sf):
    return contingency.rounded(contingency.binary_strength(_counts(spark, sf)), ["dim"])


def strength_bucket_histogram(spark, sf):
    return _records(spark, sf).where("has_strength").groupBy("grp", "strength").agg(F.count(F.lit(1)).alias("n"))


def bh_adjust(spark, sf):
    out = multitest.benjamini_hochberg(_tests(spark, sf), "dim", "p")
    lg = lambda c: F.when(F.col(c) > 0, F.round(F.log10(c), 4))
    return out.select("name", lg("p").alias("log10_p"), lg("adjusted").alias("log10_adjusted"), "significant")


def fdr_sorted(spark, sf):
    """The adjusted tests with their hypothesis, numbered from the smallest p on."""
    out = multitest.benjamini_hochberg(_tests(spark, sf), "dim", "p", order="place")
    name = F.create_map(*[F.lit(x) for kv in HYPOTHESES.items() for x in kv])
    return out.select(F.col("place").cast("long").alias("place"), "name", name[F.col("name")].alias("hypothesis"), "significant").orderBy("place")


def significance_tally(spark, sf):
    """Per field: Yes or No for each dimension and how many of the six are Yes."""
    rows = cut_lineage(_records(spark, sf))
    tables = contingency.chi_square(contingency.dense(contingency.counts_for_tests(rows), ["field"]), ["field", "dim"]).select("field", "dim", "p")
    tests = tables.unionAll(ranks.mann_whitney(rows, "grp", "similarity", ["field"]).select("field", F.lit("similarity").alias("dim"), "p"))
    return contingency.tally(tests, "field", "dim", list(HYPOTHESES))


def mann_whitney_aggregate(spark, sf):
    return ranks.report(ranks.mann_whitney(_records(spark, sf), "grp", "similarity"), [])


def mann_whitney_by_field(spark, sf):
    return ranks.report(ranks.mann_whitney(_records(spark, sf), "grp", "similarity", ["field"]), ["field"])


def group_mean_sd(spark, sf):
    return _records(spark, sf).where("similarity is not null").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.stddev_samp("similarity"), 6).alias("sd")
    )


def union_rows(spark, sf):
    """Counts of all dimensions and of the journals under each other, with their kind."""
    counts = contingency.dense(_counts(spark, sf)).groupBy("dim").agg(F.sum("n").alias("n")).select(F.lit("dimension").alias("kind"), F.col("dim").alias("name"), "n")
    listed = table(spark, sf, "journals").select(F.lit("journal").alias("kind"), F.col("journal").alias("name"), F.col("published_articles").alias("n"))
    return counts.unionByName(listed)


def report_dimension_table(spark, sf):
    """Counts and shares of both groups side by side, categories under their display names."""
    return contingency.report(contingency.dense(_counts(spark, sf)))


def report_field_table(spark, sf):
    return contingency.report(contingency.dense(_counts(spark, sf), ["field"]), ["field"])


def _matrix(spark, sf, cluster: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("category")) for d in ("position", "distance", "function", "depth", "strength")]))
    long = _records(spark, sf).select("grp", F.col(cluster).alias("c"), cells.alias("x")).select("grp", "c", "x.dim", "x.category")
    return cut_lineage(clusters.cluster_counts(long, "c", "category", ["dim"]))


def cluster_matrix(spark, sf):
    return clusters.cluster_counts(_records(spark, sf), "article_id", "depth")


def cluster_sum_count(spark, sf):
    return clusters.cluster_sums(_records(spark, sf), "article_id", "similarity").withColumn("total", F.round("total", 6))


def observed_diff_flag(spark, sf):
    """Differences of shares with article-level intervals."""
    out = clusters.with_intervals(_matrix(spark, sf, "article_id"), BOOTSTRAPS, ["dim"])
    return _six(out)


def bootstrap_paired_ci(spark, sf):
    """Differences of shares with journal-level intervals, fields drawn for both groups alike."""
    rows = _matrix(spark, sf, "field")
    return _six(clusters.with_intervals(rows, BOOTSTRAPS, ["dim"], paired=True))


def _six(out: DataFrame) -> DataFrame:
    return out.select("dim", "category", *[F.round(c, 6).alias(c) for c in ("difference", "lower", "upper")], "excludes_zero")


def bootstrap_cluster_ci(spark, sf):
    sums = cut_lineage(clusters.cluster_sums(_records(spark, sf), "article_id", "similarity"))
    return clusters.bootstrap_means(sums, BOOTSTRAPS).select(F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "iterations")


def mc_p_numpy(spark, sf):
    """Monte-Carlo p of every dimension, of all records and per field, one task per table."""
    counts = _counts(spark, sf)
    scopes = counts.withColumn("scope", F.explode(F.array(F.lit("aggregate"), F.concat(F.lit("field"), F.col("field")))))
    arrays = clusters.count_arrays(contingency.dense(scopes, ["scope"]), ["scope", "dim"])
    tests = arrays.select(F.concat_ws(":", "scope", "dim").alias("test"), "n1", "n2").repartition("test")
    return clusters.monte_carlo(tests, TABLES)


def anchor_block_anomalies(spark, sf):
    out = quality.anchor_blocks(_records(spark, sf))
    return out.select("workbook", "strength_id", "source_row", "strength", *[F.col(c).cast("long").alias(c) for c in ("block_rows", "articles", "cited_texts")], "flags")


def distinct_with_fill(spark, sf):
    return quality.filled_pairs(_records(spark, sf))


def label_qc_counts(spark, sf):
    return quality.label_counters(_records(spark, sf))


def raw_value_histogram(spark, sf):
    return quality.value_histogram(_records(spark, sf), "position_raw")


def label_lists(spark, sf):
    """Sorted distinct labels of each group."""
    return _records(spark, sf).groupBy("grp").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


def valid_rejected_counts(spark, sf):
    """Rows per reason of rejection; valid rows have an empty reason."""
    required = ["self_cited_article", "citation_content", "citation_position"]
    domains = {"citation_function": FUNCTION, "citation_depth": DEPTH}
    return quality.validity(table(spark, sf, "annotation_rows"), required, domains).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def score_counters(spark, sf):
    """Rows with a score, rows skipped for a blank text, rows whose score is missing, and sums over the texts."""
    return quality.pass_counters(table(spark, sf, "annotation_rows"), "self_cited_article_abstract", "citation_content", "semantic_similarity")


def selection_without_total(spark, sf):
    """Journals of the selection with a total row added and left out again."""
    return quality.without_total(quality.with_total(table(spark, sf, "journals").select("label", "journal", "published_articles", "candidate_articles"), "label"), "label")


def selection_total(spark, sf):
    return quality.with_total(table(spark, sf, "journals").select("label", "journal", "published_articles", "candidate_articles"), "label").where("label = 'Total'")


QUERIES = [
    mentions_projection, forward_fill_ids, article_runs, category_counts_dense, category_percentages, chi_square_aggregate, chi_square_by_field,
    chi_square_expected_diag, chi_square_odd_df, chi_square_grouping_sets, leave_one_label_out, binary_collapse_sensitivity, strength_bucket_histogram,
    bh_adjust, fdr_sorted, significance_tally, mann_whitney_aggregate, mann_whitney_by_field, group_mean_sd, union_rows, report_dimension_table,
    report_field_table, cluster_matrix, cluster_sum_count, observed_diff_flag, bootstrap_paired_ci, bootstrap_cluster_ci, mc_p_numpy,
    anchor_block_anomalies, distinct_with_fill, label_qc_counts, raw_value_histogram, label_lists, valid_rejected_counts, score_counters,
    selection_without_total, selection_total,
]


def _display_sql(c: str) -> str:
    return f"case {c} " + " ".join(f"when '{a}' then '{b}'" for a, b in DISPLAY.items()) + f" else {c} end"


def _report_sql(keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return LONG + f"""select {k}dim, ord, {_display_sql('category')} as category, n1, n2,
      round(n1 / nullif(sum(n1) over (partition by {k}dim), 0), 6) as share1, round(n2 / nullif(sum(n2) over (partition by {k}dim), 0), 6) as share2
      from (select {k}dim, ord, category, max(n) filter (grp = 'G1') as n1, max(n) filter (grp = 'G2') as n2 from ({cells_sql(keys)}) group by all)"""


def _rank_parts(keys: str = "") -> str:
    """Rank sums per key: the chain ends with t."""
    k, part = (keys + ", ", f"partition by {keys} ") if keys else ("", "")
    return RECORDS + f""", ties as (select {k}similarity as v, count(*) as t, count(*) filter (grp = 'G1') as t1 from r where similarity is not null group by all),
ranked as (select *, coalesce(sum(t) over ({part}order by v rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2.0::double as rk from ties),
s as (select {k}sum(rk * t1)::double as r1, sum(t1)::double as n1, sum(t - t1)::double as n2, sum(t::double ** 3 - t) as ties from ranked group by all),
u as (select *, r1 - n1 * (n1 + 1) / 2 as u1, n1 * n2 as prod, n1 * n2 / 12 * ((n1 + n2 + 1) - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0)) as var from s),
w as (select *, (abs(u1 - prod / 2) - case when u1 <> prod / 2 then 0.5 else 0 end) / nullif(sqrt(var), 0) as raw from u),
t as (select *, case when u1 < prod / 2 then -raw else raw end as z, {erfc_sql('abs(raw) / sqrt(2)')} as p, 1 - 2 * u1 / nullif(prod, 0) as rb from w)
"""


def _mw_sql(keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return _rank_parts(keys) + f"""select {k}round(u1, 6) as u1, round(z, 6) as z, case when p > 0 then round(log10(p), 4) end as log10_p,
      round(rb, 6) as rank_biserial, n1::bigint as n1, n2::bigint as n2 from t"""


def _interval_sql(cluster: str, paired: bool) -> str:
    salt = "'p'" if paired else "grp"
    base = "max(size)::double" if paired else "sum(w * whole)::double"
    part = "w * n / whole::double" if paired else "(w * n)::double"
    return LONG + f""", m as (select dim, grp, {cluster} as cluster, category, count(*) as n from long group by all),
c as (select dim, grp, cluster, sum(n) as whole from m group by all),
p as (select *, row_number() over (partition by dim, grp order by md5(cluster), cluster) - 1 as pos, count(*) over (partition by dim, grp) as size from c),
dr as (select dim, grp, it, size, {draw_sql('dim', salt, 'it', 'pos')} % size as pos from p, range({BOOTSTRAPS}) x(it)),
w as (select dim, grp, it, pos, count(*) as w from dr group by all),
j as (select w.*, p.cluster, p.whole, p.size from w join p using (dim, grp, pos)),
bs as (select dim, grp, it, {base} as base from j group by all),
h as (select dim, category, grp, it, sum({part}) as hit from j join m using (dim, grp, cluster) group by all),
f as (select * from (select distinct dim, category from m), range({BOOTSTRAPS}) x(it)),
ds as (select f.dim, f.category, f.it, coalesce(sum(case when h.grp = 'G1' then hit else -hit end / base), 0) as d from f
  left join h on h.dim = f.dim and h.category = f.category and h.it = f.it left join bs on bs.dim = h.dim and bs.grp = h.grp and bs.it = h.it group by all),
ci as (select dim, category, quantile_cont(d, 0.025) as lower, quantile_cont(d, 0.975) as upper from ds group by all),
o as (select dim, category, coalesce(n1 / nullif(sum(n1) over (partition by dim), 0), 0) - coalesce(n2 / nullif(sum(n2) over (partition by dim), 0), 0) as difference from
  (select dim, category, coalesce(sum(n) filter (grp = 'G1'), 0) as n1, coalesce(sum(n) filter (grp <> 'G1'), 0) as n2 from m group by all))
select dim, category, round(difference, 6) as difference, round(lower, 6) as lower, round(upper, 6) as upper, (lower > 0 or upper < 0) as excludes_zero
from o join ci using (dim, category)"""


_DIM = cells_sql()
_FIELD = cells_sql("field")
_TESTS = f"(select dim, p from ({chi_sql(_DIM, 'dim')}) union all select 'similarity', p from t)"
_PREFIX = _rank_parts() + LONG[len(RECORDS):]
_BH = _PREFIX + f""", q as (select dim as name, p, row_number() over (order by p, dim) as place, count(*) over () as m from {_TESTS} where p is not null),
a as (select name, p, place, least(1.0, min(p * m / place) over (order by place desc rows between unbounded preceding and current row)) as adj from q) """
_HYP = "case name " + " ".join(f"when '{k}' then '{v}'" for k, v in HYPOTHESES.items()) + " end"
_TALLY = _rank_parts("field") + LONG[len(RECORDS):] + f""", q as (select field, dim, p from ({chi_sql(_FIELD, 'field, dim')}) union all select field, 'similarity', p from t)
select field, {', '.join(f"coalesce(max(case when p < 0.05 then 'Yes' else 'No' end) filter (dim = '{d}'), 'No') as {d}" for d in HYPOTHESES)},
  (count(*) filter (p < 0.05)) || '/6' as total from q group by field"""

ORACLE = {
    "mentions_projection": RECORDS + f"""select mention_id, workbook, source_row, label, grp, field, field_name, r.journal, article_id, position, distance,
      strength, function, depth, round(similarity, 6) as similarity from r left join (select distinct field_no::varchar as field, field_name from journals) j using (field)""",
    "forward_fill_ids": RECORDS + "select mention_id, article_title, cited, article_id, strength_id, anchor_no from r",
    "article_runs": RECORDS + """select workbook, article_id, count(*) as n_rows, min(source_row) as first_row, max(source_row) as last_row, max(title_anchor) as title
      from r group by all""",
    "category_counts_dense": LONG + _DIM,
    "category_percentages": LONG + f"select dim, category, grp, round(n / nullif(sum(n) over (partition by dim, grp), 0), 6) as share from ({_DIM})",
    "chi_square_aggregate": LONG + rounded_sql(chi_sql(_DIM, "dim"), "dim"),
    "chi_square_by_field": LONG + rounded_sql(chi_sql(_FIELD, "field, dim"), "field, dim"),
    "chi_square_expected_diag": LONG + f"select field, dim, expected_lt5, cells, round(min_expected, 6) as min_expected from ({chi_sql(_FIELD, 'field, dim')})",
    "chi_square_odd_df": LONG + rounded_sql(chi_sql(f"select * from ({_DIM}) where ord > 1", "dim"), "dim"),
    "chi_square_grouping_sets": LONG + ", sc as (select *, 'all' as scope from long union all select *, 'field ' || field from long) " + rounded_sql(
        chi_sql(cells_sql("scope", "sc"), "scope, dim"), "scope, dim"),
    "leave_one_label_out": LONG + f", lo as (select long.*, x.excluded from long cross join (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in LABELS)}) x(excluded) where label <> excluded) "
    + rounded_sql(chi_sql(cells_sql("excluded", "lo"), "excluded, dim"), "excluded, dim"),
    "binary_collapse_sensitivity": LONG + rounded_sql(
        chi_sql(f"select dim, case when category = '1' then '1' else '>1' end as category, grp, sum(n) as n from ({_DIM}) where dim = 'strength' group by all", "dim"), "dim"),
    "strength_bucket_histogram": RECORDS + "select grp, strength, count(*) as n from r where has_strength group by all",
    "bh_adjust": _BH + "select name, case when p > 0 then round(log10(p), 4) end as log10_p, case when adj > 0 then round(log10(adj), 4) end as log10_adjusted, adj < 0.05 as significant from a",
    "fdr_sorted": _BH + f"select place, name, {_HYP} as hypothesis, adj < 0.05 as significant from a order by place",
    "significance_tally": _TALLY,
    "mann_whitney_aggregate": _mw_sql(),
    "mann_whitney_by_field": _mw_sql("field"),
    "group_mean_sd": RECORDS + "select grp, count(*) as n, round(avg(similarity), 6) as mean, round(stddev_samp(similarity), 6) as sd from r where similarity is not null group by grp",
    "union_rows": LONG + f"select 'dimension' as kind, dim as name, sum(n)::bigint as n from ({_DIM}) group by dim union all select 'journal', journal, published_articles from journals",
    "report_dimension_table": _report_sql(),
    "report_field_table": _report_sql("field"),
    "cluster_matrix": RECORDS + "select grp, article_id as cluster, depth as category, count(*) as n from r group by all",
    "cluster_sum_count": RECORDS + "select grp, article_id as cluster, round(sum(similarity), 6) as total, count(*) as n from r where similarity is not null group by all",
    "observed_diff_flag": _interval_sql("article_id", False),
    "bootstrap_paired_ci": _interval_sql("field", True),
    "bootstrap_cluster_ci": RECORDS + f""", c as (select grp, article_id as cluster, sum(similarity) as total, count(*) as n from r where similarity is not null group by all),
p as (select *, row_number() over (partition by grp order by md5(cluster), cluster) - 1 as pos, count(*) over (partition by grp) as size from c),
dr as (select grp, it, {draw_sql('grp', 'it', 'pos')} % size as pos from p, range({BOOTSTRAPS}) x(it)),
m as (select it, grp, sum(total) / sum(n) as mean from dr join p using (grp, pos) group by all),
ds as (select max(mean) filter (grp = 'G1') - max(mean) filter (grp = 'G2') as d from m group by it)
select round(quantile_cont(d, 0.025), 6) as lower, round(quantile_cont(d, 0.975), 6) as upper, count(*) as iterations from ds""",
    "anchor_block_anomalies": RECORDS + """, k as (select workbook, anchor_no, max(strength_id) as strength_id, min(source_row) as source_row, max(strength_value)::int as strength,
  count(*) as block_rows, count(distinct article_id) as articles, count(distinct nullif(cited_raw, '')) as cited_texts from r where anchor_no > 0 group by workbook, anchor_no)
select workbook, strength_id, source_row, strength, block_rows, articles, cited_texts, flags from (select *, concat_ws(',', case when block_rows <> strength then 'block_length_differs_from_strength' end,
  case when articles <> 1 then 'block_crosses_article_boundary' end, case when cited_texts > 1 then 'multiple_self_cited_strings_within_block' end) as flags from k) where flags <> ''""",
    "distinct_with_fill": RECORDS + "select label, count(*) as pairs from (select distinct label, coalesce(article_title, ''), coalesce(cited, '') from r) group by label",
    "label_qc_counts": RECORDS + """select 'all' as grp, 'all' as label, count(*) as mentions, count(distinct article_id) as articles, count(*) filter (has_strength) as strength_rows from r
  union all select grp, 'all', count(*), count(distinct article_id), count(*) filter (has_strength) from r group by grp
  union all select grp, label, count(*), count(distinct article_id), count(*) filter (has_strength) from r group by grp, label""",
    "raw_value_histogram": RECORDS + "select position_raw as value, count(*) as n from r group by all",
    "label_lists": RECORDS + "select grp, string_agg(label, ',' order by label) as labels from (select distinct grp, label from r) group by grp",
    "valid_rejected_counts": f"""with t as (select {', '.join(f"coalesce({strip_sql(c)}, '') as {c}" for c in ("self_cited_article", "citation_content", "citation_position", "citation_function", "citation_depth"))} from annotation_rows)
select reason, count(*) as n from (select case
  when self_cited_article = '' and citation_content = '' and citation_position = '' and citation_function = '' and citation_depth = '' then 'blank'
  when self_cited_article = '' then 'missing self_cited_article' when citation_content = '' then 'missing citation_content' when citation_position = '' then 'missing citation_position'
  when citation_function not in ({', '.join(f"'{x}'" for x in FUNCTION)}) then 'unknown citation_function'
  when citation_depth not in ({', '.join(f"'{x}'" for x in DEPTH)}) then 'unknown citation_depth' else '' end as reason from t) group by reason""",
    "score_counters": f"""select count(*) as n_rows, count(*) filter (not both_filled) as skipped, count(*) filter (both_filled and semantic_similarity is not null) as scored,
  count(*) filter (both_filled and semantic_similarity is null) as failed, coalesce(sum(words) filter (both_filled), 0)::bigint as words,
  count(*) filter (both_filled and self_cited_article_abstract = citation_content) as unchanged
  from (select *, {filled_sql('self_cited_article_abstract')} and {filled_sql('citation_content')} as both_filled,
    len(regexp_extract_all(citation_content, '[^ ]+')) as words from annotation_rows)""",
    "selection_without_total": "select label, journal, published_articles, candidate_articles from journals",
    "selection_total": "select 'Total' as label, null::varchar as journal, sum(published_articles)::bigint as published_articles, sum(candidate_articles)::bigint as candidate_articles from journals",
}
