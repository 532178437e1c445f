"""Queries of label agreement, chat records and vectors, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions.text import strip
from colophon.functions.vocab import DEPTH, FUNCTION, TRAINING_FUNCTION
from colophon.operators import agreement, chat, vectors
from colophon.plans.runtime import cut_lineage, table
from colophon.plans.sql import squeeze_sql, strip_sql

LONG_PROMPT = "You label self-citations. Read the citation content and return one function and one depth as JSON."
SHORT_PROMPT = "Return one function and one depth as JSON."
LONG_RATE, VALIDATION, SEED = 0.7, 0.1, 42
#: Components of the whitened vectors in the query.
KERNEL_COLUMNS = 16


def label_rows(spark, sf) -> DataFrame:
    """(actual, predicted, actual_depth, predicted_depth): rows of the test set with the answer of the chat record of the same article and title."""
    turn = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    answer = turn("assistant")
    answers = table(spark, sf, "chat_records").where("split = 'test'").select(
        F.regexp_extract(turn("user"), r"(?m)^Self-cited Article Index: (.*)$", 1).alias("i"), strip(F.regexp_extract(turn("user"), r"(?m)^Self-cited Article Title: (.*)$", 1)).alias("t"),
        F.regexp_extract(answer, r'"Final Citation Function": "([^"]*)"', 1).alias("predicted"),
        F.regexp_extract(answer, r'"Final Citation Depth": "([^"]*)"', 1).alias("predicted_depth"),
    )
    truth = table(spark, sf, "test_set").select(
        F.col("self_citing_article_index").alias("i"), strip(F.col("self_cited_article_title")).alias("t"), F.col("citation_function").alias("actual"),
        F.col("citation_depth").alias("actual_depth"),
    )
    return truth.join(answers, ["i", "t"])


def _counts(spark, sf, depth: bool = False) -> DataFrame:
    side = "_depth" if depth else ""
    return cut_lineage(agreement.pair_counts(label_rows(spark, sf), "actual" + side, "predicted" + side, strict=False))


def label_pairs(spark, sf):
    """Pairs of labels, complete and half blank."""
    return agreement.label_pairs(label_rows(spark, sf), "actual", "predicted").groupBy("complete").agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(spark, sf):
    both = agreement.cohen_kappa(_counts(spark, sf)).withColumn("labels", F.lit("function")).unionByName(
        agreement.cohen_kappa(_counts(spark, sf, True)).withColumn("labels", F.lit("depth"))
    )
    return both.select("labels", "n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def confusion_matrix(spark, sf):
    return agreement.confusion(_counts(spark, sf)).select("actual", "predicted", F.col("n").cast("long").alias("n"))


def class_metrics(spark, sf):
    out = agreement.class_metrics(_counts(spark, sf))
    return out.select("category", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


def macro_weighted(spark, sf):
    out = agreement.average_metrics(agreement.class_metrics(_counts(spark, sf)))
    return out.select("average", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")], F.col("n").cast("long").alias("n"))


def unrepresented_labels(spark, sf):
    return agreement.missing_labels(_counts(spark, sf), FUNCTION).select(F.col("ord").cast("long").alias("ord"), "category")


def report_confusion_pivot(spark, sf):
    out = agreement.confusion_pivot(_counts(spark, sf, True), DEPTH)
    return out.select("actual", *[F.col(f"`{c}`").cast("long").alias(c) for c in DEPTH])


def label_union(spark, sf):
    return agreement.label_union(_counts(spark, sf)).select("label", F.col("as_actual").cast("long").alias("as_actual"), F.col("as_predicted").cast("long").alias("as_predicted"))


def ranked_confusions(spark, sf):
    return agreement.ranked_confusions(_counts(spark, sf)).select("actual", "predicted", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank"))


def _sheet(spark, sf) -> DataFrame:
    return table(spark, sf, "test_set").select(
        F.col("record_id").alias("key"), F.col("self_citing_article_index").alias("article_index"), F.col("self_cited_article_title").alias("title"),
        F.col("citation_content").alias("content"), F.col("citation_location").alias("location"), F.col("citation_function").alias("function"),
        F.col("citation_depth").alias("depth"),
    )


def chat_build(spark, sf):
    """System, user and assistant turns of the valid rows of the test set."""
    built = chat.build(_sheet(spark, sf), LONG_PROMPT, SHORT_PROMPT, LONG_RATE, SEED)
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    return built.select(F.col("key").alias("record_id"), turn(0).alias("system"), turn(1).alias("user"), turn(2).alias("assistant"))


def chat_rejected(spark, sf):
    """Rows of the test set that build no record, with the reason."""
    return chat.labelled_rows(_sheet(spark, sf)).where("reason <> ''").select(F.col("key").alias("record_id"), "reason")


def prompt_choice_split(spark, sf):
    built = chat.build(_sheet(spark, sf), LONG_PROMPT, SHORT_PROMPT, LONG_RATE, SEED)
    placed = chat.split(built, VALIDATION, SEED)
    return placed.select(F.col("key").alias("record_id"), (F.get("messages", F.lit(0))["content"] == LONG_PROMPT).alias("long"), "place", "split")


def chat_validate(spark, sf):
    """Records per fault of their turns."""
    return table(spark, sf, "chat_records").groupBy(chat.message_fault(F.col("messages")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def chat_lines_validate(spark, sf):
    """The same records as JSON lines, read and validated as a file would be."""
    lines = table(spark, sf, "chat_records").select("record_id", F.to_json(F.struct("messages")).alias("value"))
    return chat.line_faults(lines).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def chat_splits(spark, sf):
    return table(spark, sf, "chat_records").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(F.greatest(F.size("messages"), F.lit(0))), F.lit(0)).cast("long").alias("n_turns")
    )


def _pairs(spark, sf) -> DataFrame:
    return vectors.neighbour_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


def similarity_cosine(spark, sf):
    return _pairs(spark, sf).select("key_a", "key_b", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def similarity_sign(spark, sf):
    return _pairs(spark, sf).select("key_a", "key_b", F.round(vectors.sign_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def mean_vector(spark, sf):
    out = vectors.mean_vectors(table(spark, sf, "embeddings"), "label", "embedding")
    return out.select("label", F.col("at").cast("long").alias("at"), F.round("mean", 6).alias("mean"), "n")


def chunk_mean(spark, sf):
    """Mean of two chunk vectors: a vector and its reverse."""
    v = vectors.doubles(F.col("embedding"))
    mean = vectors.mean_of_chunks(F.array(v, F.reverse(v)))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(mean, F.lit(0)), 6).alias("first"), F.round(F.get(mean, F.size(mean) - 1), 6).alias("last"))


def whitening(size: int = 64, columns: int = KERNEL_COLUMNS) -> vectors.Whitening:
    """Parameters by rule, for the query and its SQL."""
    return vectors.Whitening([[math.cos((i + 1) * (j + 1)) for j in range(columns)] for i in range(size)], [(i % 7 - 3) / 100 for i in range(size)])


def whiten_transform(spark, sf):
    out = vectors.whitened(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", "white", whitening())
    return out.select("vec_id", F.posexplode("white").alias("component", "x")).select("vec_id", F.col("component").cast("long").alias("component"), F.round("x", 6).alias("x"))


QUERIES = [
    label_pairs, cohen_kappa, confusion_matrix, class_metrics, macro_weighted, unrepresented_labels, report_confusion_pivot, label_union, ranked_confusions,
    chat_build, chat_rejected, prompt_choice_split, chat_validate, chat_lines_validate, chat_splits, similarity_cosine, similarity_sign, mean_vector, chunk_mean,
    whiten_transform,
]

LABELS_SQL = rf"""with an as (select list_filter(messages, lambda m: m.role = 'user')[1].content as u, list_filter(messages, lambda m: m.role = 'assistant')[1].content as a from chat_records where split = 'test'),
ans as (select regexp_extract(u, '(?m)^Self-cited Article Index: (.*)$', 1) as i, {strip_sql("regexp_extract(u, '(?m)^Self-cited Article Title: (.*)$', 1)")} as t,
  regexp_extract(a, '"Final Citation Function": "([^"]*)"', 1) as predicted, regexp_extract(a, '"Final Citation Depth": "([^"]*)"', 1) as predicted_depth from an),
lr as (select coalesce({squeeze_sql('citation_function')}, '') as actual, coalesce({squeeze_sql('citation_depth')}, '') as actual_depth, coalesce({squeeze_sql('predicted')}, '') as predicted,
  coalesce({squeeze_sql('predicted_depth')}, '') as predicted_depth from test_set join ans on self_citing_article_index = i and {strip_sql('self_cited_article_title')} = t),
ct as (select actual, predicted, count(*) as n from lr where actual <> '' and predicted <> '' group by all),
cd as (select actual_depth as actual, predicted_depth as predicted, count(*) as n from lr where actual_depth <> '' and predicted_depth <> '' group by all),
lb as (select distinct unnest([actual, predicted]) as label from ct),
sq as (select a.label as actual, b.label as predicted, coalesce(ct.n, 0) as n from lb a cross join lb b left join ct on ct.actual = a.label and ct.predicted = b.label),
me as (select category, hit / greatest(pred, 1)::double as precision, hit / greatest(sup, 1)::double as recall, sup, hit from (
  select l.label as category, (select sum(n) from sq where sq.actual = l.label and sq.predicted = l.label) as hit, (select sum(n) from sq where sq.actual = l.label) as sup,
    (select sum(n) from sq where sq.predicted = l.label) as pred from lb l)),
mf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from me)
"""


def _kappa_sql(name: str, t: str) -> str:
    return f"""select '{name}' as labels, n, round(po, 6) as observed, round(pe, 6) as expected, round((po - pe) / nullif(1 - pe, 0), 6) as kappa from (
  select sum(n)::bigint as n, sum(n) filter (actual = predicted) / sum(n)::double as po, (select coalesce(sum(a.n::double * b.n), 0) from (select actual, sum(n) as n from {t} group by 1) a
    join (select predicted, sum(n) as n from {t} group by 1) b on a.actual = b.predicted) / (sum(n)::double * sum(n)) as pe from {t})"""


_SHEET = f"""with sh as (select record_id, coalesce({strip_sql('self_citing_article_index')}, '') as i, coalesce({strip_sql('self_cited_article_title')}, '') as t, coalesce({strip_sql('citation_content')}, '') as c,
  coalesce({strip_sql('citation_location')}, '') as l, coalesce({strip_sql('citation_function')}, '') as f, coalesce({strip_sql('citation_depth')}, '') as d from test_set),
ok as (select *, case when t = '' and c = '' and l = '' and f = '' and d = '' then 'blank' when t = '' then 'missing title' when c = '' then 'missing content' when l = '' then 'missing location'
  when f not in ({', '.join(f"'{x}'" for x in TRAINING_FUNCTION)}) then 'unknown function' when d not in ({', '.join(f"'{x}'" for x in DEPTH)}) then 'unknown depth' else '' end as reason,
  ('0x' || substr(md5('{SEED}-' || record_id), 1, 8))::bigint / 4294967296.0 < {LONG_RATE} as long from sh)
"""
_FAULT = """case when messages is null or len(messages) = 0 then 'no messages' when len(list_filter(messages, lambda m: m is null)) > 0 then 'message is no object'
  when len(list_filter(messages, lambda m: coalesce(m.role not in ('system', 'user', 'assistant'), true))) > 0 then 'unsupported role'
  when len(list_filter(messages, lambda m: m.content is null)) > 0 then 'content is no text' else '' end"""
_NEIGHBOURS = "with v as (select vec_id, embedding::double[] as e, label from embeddings), p as (select vec_id as key_a, lead(vec_id) over w as key_b, e as a, lead(e) over w as b from v window w as (partition by label order by vec_id)) "
_COSINE = "list_sum([{0}[i] * {1}[i] for i in range(1, len({0}) + 1)]) / (sqrt(list_sum([x * x for x in {0}])) * sqrt(list_sum([x * x for x in {1}])))"

ORACLE = {
    "label_pairs": LABELS_SQL + "select actual <> '' and predicted <> '' as complete, count(*) as n from lr where actual <> '' or predicted <> '' group by 1",
    "cohen_kappa": LABELS_SQL + _kappa_sql("function", "ct") + " union all " + _kappa_sql("depth", "cd"),
    "confusion_matrix": LABELS_SQL + "select actual, predicted, n from sq",
    "class_metrics": LABELS_SQL + "select category, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, sup::bigint as support from mf",
    "macro_weighted": LABELS_SQL + """select 'macro' as average, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, round(sum(hit) / sum(sup)::double, 6) as accuracy, sum(sup)::bigint as n from mf
union all select 'weighted', round(sum(precision * sup) / sum(sup), 6), round(sum(recall * sup) / sum(sup), 6), round(sum(f1 * sup) / sum(sup), 6), round(sum(hit) / sum(sup)::double, 6), sum(sup)::bigint from mf""",
    "unrepresented_labels": LABELS_SQL + f"select ord::bigint as ord, category from (values {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(FUNCTION, 1))}) v(ord, category) where category not in (select label from lb)",
    "report_confusion_pivot": LABELS_SQL + "select actual, " + ", ".join(f"coalesce(sum(n) filter (predicted = '{d}'), 0)::bigint as \"{d}\"" for d in DEPTH) + " from (select actual, predicted, n from cd union all select distinct predicted, '', 0 from cd) group by actual",
    "label_union": LABELS_SQL + "select label, coalesce((select sum(n) from ct where actual = label), 0)::bigint as as_actual, coalesce((select sum(n) from ct where predicted = label), 0)::bigint as as_predicted from lb",
    "ranked_confusions": LABELS_SQL + "select actual, predicted, n, dense_rank() over (order by n desc) as rank from ct where actual <> predicted",
    "chat_build": _SHEET + f"""select record_id, case when long then '{LONG_PROMPT}' else '{SHORT_PROMPT}' end as system,
  'Self-cited Article Index: ' || i || chr(10) || 'Self-cited Article Title: ' || t || chr(10) || 'Citation Location: ' || l || chr(10) || 'Citation Content: ' || c as user,
  '{{"Final Citation Function": "' || f || '", "Final Citation Depth": "' || d || '"}}' as assistant from ok where reason = ''""",
    "chat_rejected": _SHEET + "select record_id, reason from ok where reason <> ''",
    "prompt_choice_split": _SHEET + f""", pl as (select record_id, long, row_number() over (order by md5('{SEED}-' || record_id), '{SEED}-' || record_id) - 1 as place, count(*) over () as n from ok where reason = '')
select record_id, long, place, case when place < greatest(1, round_even(n * {VALIDATION}, 0)) then 'validation' else 'train' end as split from pl""",
    "chat_validate": f"select {_FAULT} as fault, count(*) as n from chat_records group by 1",
    "chat_lines_validate": f"select {_FAULT} as fault, count(*) as n from chat_records group by 1",
    "chat_splits": "select split, source, count(*) as n_records, coalesce(sum(coalesce(len(messages), 0)), 0)::bigint as n_turns from chat_records group by all",
    "similarity_cosine": _NEIGHBOURS + f"select key_a, key_b, round({_COSINE.format('a', 'b')}, 6) as similarity from p where key_b is not null",
    "similarity_sign": _NEIGHBOURS + f", s as (select key_a, key_b, [sign(x)::double for x in a] as a, [sign(x)::double for x in b] as b from p where key_b is not null) select key_a, key_b, round({_COSINE.format('a', 'b')}, 6) as similarity from s",
    "mean_vector": "select label, i - 1 as at, round(avg(e[i]), 6) as mean, count(*) as n from (select label, embedding::double[] as e from embeddings), range(1, 65) x(i) group by all",
    "chunk_mean": "select vec_id, round((e[1] + e[-1]) / 2, 6) as first, round((e[-1] + e[1]) / 2, 6) as last from (select vec_id, embedding::double[] as e from embeddings)",
    "whiten_transform": f"""with v as (select vec_id, embedding::double[] as e from embeddings),
w as (select vec_id, j as component, list_sum([(e[i] + ((i - 1) % 7 - 3) / 100::double) * cos(i * (j + 1)) for i in range(1, len(e) + 1)]) as x from v, range({KERNEL_COLUMNS}) t(j))
select vec_id, component, round(x / sqrt(sum(x * x) over (partition by vec_id)), 6) as x from w""",
}
