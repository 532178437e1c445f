"""Queries of the llm problems over a data directory, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.llm import chunking, encoding, groups, lookalike, mixing, overlap, packing, sentences, truncation
from colophon.plans.runtime import table

FIELDS_6 = ["citation_content", "self_cited_article"]


def _rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "annotation_rows").select(*columns)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf, "mention_id", "workbook", "citation_content")
    return truncation.truncated_values(rows, documents=_documents(spark, sf))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_values(spark, sf).select("mention_id")


def p1_journal_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions and truncated mentions per journal; each mention counts once."""
    found = p1_values(spark, sf).select("mention_id", F.lit(1).alias("hit"))
    mentions = _rows(spark, sf, "mention_id", "journal").groupBy("mention_id").agg(F.max(F.trim("journal")).alias("journal"))
    return (
        mentions.join(found, "mention_id", "left").groupBy("journal")
        .agg(F.count(F.lit(1)).alias("mentions"), F.count("hit").alias("truncated"))
        .withColumn("truncated_share", F.round(F.col("truncated") / F.col("mentions"), 6))
    )


def _split_records(spark: SparkSession, sf: str) -> DataFrame:
    chat = table(spark, sf, "chat_records").select("record_id", "split", "source", F.explode(overlap.user_contents()).alias("content"))
    test = table(spark, sf, "test_set").select("record_id", F.lit("test_set").alias("split"), "source", F.col("citation_content").alias("content"))
    return chat.unionAll(test)


def _split_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_pairs(_split_records(spark, sf), "record_id", "content", F.col("split") == "train")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _split_pairs(spark, sf)
    return pairs.select(F.least("key_left", "key_right").alias("record_id_a"), F.greatest("key_left", "key_right").alias("record_id_b")).distinct()


def p3_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source of the records outside train: records, overlapping records, exact and near pairs."""
    pairs = _split_pairs(spark, sf).groupBy(F.col("key_right").alias("record_id"), "key_left").agg(F.min("kind").alias("kind")).groupBy("record_id").agg(
        F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "near").alias("near")
    )
    chat = table(spark, sf, "chat_records").select("record_id", "split", "source")
    test = table(spark, sf, "test_set").select("record_id", F.lit("test_set").alias("split"), "source")
    outside = chat.unionAll(test).where("split <> 'train'").distinct()
    return outside.join(pairs, "record_id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("exact").isNotNull()).alias("overlapping"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_pairs"), F.coalesce(F.sum("near"), F.lit(0)).alias("near_pairs"),
    )


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled_values(_rows(spark, sf, "mention_id", "citation_content"), "mention_id", "citation_content", _documents(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select(F.col("key").alias("mention_id")).distinct()


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled mentions with the repaired text, the chain of decodings, and whether the original is whole again."""
    return _garbled(spark, sf).dropDuplicates(["key"]).select(
        F.col("key").alias("mention_id"), "chain", "restored", "repaired"
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.related_groups(table(spark, sf, "annotation_rows"))


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    shares = {r["split_name"]: r["target_share"] for r in table(spark, sf, "split_shares").collect()}
    return groups.assign_splits(groups.cut_lineage(p5_found(spark, sf)), shares)


def p5_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = p5_splits(spark, sf).groupBy(F.col("split").alias("split_name")).agg(F.count(F.lit(1)).alias("mentions"))
    share = F.round(F.col("mentions") / F.sum("mentions").over(Window.partitionBy()), 6)
    return table(spark, sf, "split_shares").join(counts, "split_name", "left").select(
        "split_name", "target_share", F.coalesce("mentions", F.lit(0)).alias("mentions"), share.alias("reached_share")
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    get = encoding.shared_repairer(spark, _documents(spark, sf))
    leave = {"citation_content": lambda text: get().repair(text)[0]}
    changed = lookalike.canonical_values(_rows(spark, sf, "mention_id", *FIELDS_6), "mention_id", FIELDS_6, leave)
    return changed.select(F.col("key").alias("mention_id"), "field_name").distinct()


def p6_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention with both fields in their consistent form, and which of them were changed."""
    rows = _rows(spark, sf, "mention_id", *FIELDS_6).dropDuplicates(["mention_id"])
    for field in FIELDS_6:
        rows = lookalike.with_canonical(rows, field, f"{field}_canonical")
    return rows.select(
        "mention_id", *[f"{f}_canonical" for f in FIELDS_6], *[(~F.col(f).eqNullSafe(F.col(f"{f}_canonical"))).alias(f"{f}_changed") for f in FIELDS_6]
    )


def _limits(spark: SparkSession, sf: str, unit: str) -> dict[str, tuple[int, int]]:
    rows = table(spark, sf, "size_limits").where(F.col("size_unit") == unit).collect()
    return {r["task_name"]: (r["max_size"], r["overlap_size"]) for r in rows}


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    limits = _limits(spark, sf, "chars")
    fields = {"self_cited_article_abstract": limits["split_abstract"], "citation_content": limits["split_content"]}
    return chunking.split_values(_rows(spark, sf, "mention_id", *fields), "mention_id", fields)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pieces(spark, sf).where("piece_no = 0").select("mention_id", "field_name")


P7_FOUND_SQL = """
select distinct mention_id, 'self_cited_article_abstract' as field_name from annotation_rows
where length(self_cited_article_abstract) > (select max_size from size_limits where task_name = 'split_abstract')
union all
select distinct mention_id, 'citation_content' from annotation_rows
where length(citation_content) > (select max_size from size_limits where task_name = 'split_content')
"""


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    capacities = {task: size for task, (size, _) in _limits(spark, sf, "tokens").items()}
    return packing.pack(_documents(spark, sf), capacities)


def p8_fill_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf))


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf), table(spark, sf, "mix_targets"))


def p9_share_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(p9_selection(spark, sf), table(spark, sf, "mix_targets"))


def p10_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_documents(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_documents(spark, sf), sentence=False).select("doc_id", "sent_start")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_journal_shares, p3_found, p3_overlap_counts, p4_found, p4_restored, p5_found, p5_splits, p5_split_shares,
            p6_found, p6_canonical, p7_found, p7_pieces, p8_containers, p8_fill_report, p9_selection, p9_share_report, p10_found, p10_units,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_FOUND_SQL}
