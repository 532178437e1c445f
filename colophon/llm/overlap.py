"""Problem 3: same or near-same records across splits.

Method: weighted cosine join between the splits. Each distinct text is a unit vector of word triples
(the i-th occurrence of a triple is a term of its own, so all weights of a text of N terms are
1 / sqrt(N)). All vectors are ordered alike: terms that the other side never uses first, then from
the rarest on.

1. Largest weights: a term is worth at most its weight times the largest weight it has on the other
   side, which is 0 for terms of one side. A text whose other terms can't add up to the least dot
   product of an alike pair takes no part; this is repeated, as each such text takes terms with it.
2. Residual norms: inverted lists hold a text's first terms only, up to the point where the rest of
   the vector could give less than that product less DEPTH terms: an alike pair has at least DEPTH
   terms in common inside both lists.
3. Exact dot products for the pairs that are left, then the count of differing words.

No step loses a pair that ``alike`` takes: a changed word touches GRAM triples and moves the others
by no more places than words are changed, so the least dot product, the range of lengths and the
range of places follow from WORD_SHARE, whatever the number of texts.

Equal texts are collapsed before the join and expanded after it, so a text that holds a third of
all rows costs one vector. No cap, no sample. Long lists of a term are split by the adaptive skew join.

Defined cases: NULL texts and texts without letters or digits are in no pair; texts of fewer than
four words are paired only if equal; a record isn't paired with a record of its own side; repeated
rows give one pair. A record with several user turns has several texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass, cut_lineage

#: Greatest share of differing words: "about one word in eight" takes in one word in seven, as a word split in
#: two or a mark counted as a word moves the share of a true case.
WORD_SHARE = 1 / 7
#: Words of a term.
GRAM = 3
#: Terms that a pair must have in common inside the inverted lists.
DEPTH = 2
#: Rounds of pruning by largest weights.
ROUNDS = 2


def comparable(text: Column) -> Column:
    """Text without case, white space and punctuation: words parted by single spaces, East Asian signs one by one."""
    low = F.lower(text)
    spread = F.when(F.octet_length(low) == F.length(low), low).otherwise(
        F.regexp_replace(low, r"([\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{0e00}-\x{0e7f}])", " $1 ")
    )
    return F.trim(F.regexp_replace(spread, r"[^\p{L}\p{M}\p{N}]+", " "))


def word_difference(a: list[str], b: list[str], most: int) -> int:
    """Words inserted, deleted or replaced between two word lists; ``most`` + 1 if they are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b))
    extra, missing = Counter(a), Counter(b)
    if max((extra - missing).total(), (missing - extra).total()) > most:
        return most + 1
    far = most + 1
    previous = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row, best = {}, far
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                cost = i
            else:
                cost = min(
                    previous.get(j - 1, far) + (x != b[j - 1]), previous.get(j, far) + 1, row.get(j - 1, far) + 1
                )
            row[j] = cost
            best = min(best, cost)
        if best > most:
            return far
        previous = row
    return min(previous.get(len(b), far), far)


def most_changes(words: int, share: float = WORD_SHARE) -> int:
    """Words that may differ in texts of at most so many words: one at least, none under four words."""
    return max(1, int(share * words)) if words >= 4 else 0


def alike(a: str, b: str, share: float = WORD_SHARE) -> bool:
    """Whether two comparable texts differ in at most about ``share`` of their words."""
    x, y = a.split(), b.split()
    most = min(most_changes(max(len(x), len(y)), share), most_changes(min(len(x), len(y)), 1.0))
    return word_difference(x, y, most) <= most


def cosine(a: str, b: str) -> float:
    """Dot product of the unit vectors of two comparable texts."""
    x, y = (Counter(zip(w, w[1:], w[2:], strict=False)) for w in (["^", *t.split(), "$"] for t in (a, b)))
    return (x & y).total() / (x.total() * y.total()) ** 0.5


def _changes(words: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(share) * words + 1e-9).cast("int"))


def _least_common(words: Column, share: float) -> Column:
    """Terms that a text of so many words has in common with any alike text that is as long or longer."""
    terms = words + (3 - GRAM)
    return F.greatest(F.lit(1), F.ceil(terms - GRAM * F.greatest(F.lit(1.0), F.lit(share) * words) - 1e-9).cast("int"))


def term_lists(texts: DataFrame, places: bool = True) -> DataFrame:
    """(tid, a, b, n, term[, lo, hi]): terms of texts (tid, norm, a, b) of four or more words; nothing is shuffled.

    ``n`` counts words, ``lo`` and ``hi`` are the first and last place of the word triple in the text. The first occurrence
    of a triple is named by the triple, the k-th by triple and k.
    """
    words = F.split(F.concat(F.lit("^ "), F.col("norm"), F.lit(" $")), " ")
    grams = F.expr(f"transform(sequence(0, size(v) - {GRAM}), i -> xxhash64({', '.join(f'v[i + {k}]' for k in range(GRAM))}))")
    listed = texts.select("tid", "a", "b", words.alias("v")).where(F.size("v") >= 6).select("tid", "a", "b", (F.size("v") - 2).alias("n"), grams.alias("g"))
    # sorted, equal triples stand together: most have no neighbour of their own and need no search
    ordered = listed.withColumn("s", F.expr("array_sort(transform(g, (x, i) -> struct(x as g, i as i)))")).withColumn("g", F.expr("transform(s, e -> e.g)"))
    again = "i > 0 and g[i - 1] = e.g"
    term = f"case when {again} then xxhash64(e.g, i - array_position(g, e.g) + 2) else e.g end as term"
    shared = f"({again} or i < size(g) - 1 and g[i + 1] = e.g)"
    range_ = (
        f", case when {shared} then s[int(array_position(g, e.g)) - 1].i else e.i end as lo"
        f", case when {shared} then s[size(g) - int(array_position(reverse(g), e.g))].i else e.i end as hi"
    )
    parts = F.explode(F.expr(f"transform(s, (e, i) -> struct({term}{range_ if places else ''}))")).alias("t")
    return ordered.select("tid", "a", "b", "n", parts).select("tid", "a", "b", "n", "t.*")


def _used(terms: DataFrame) -> DataFrame:
    """(term, df): terms that both sides use."""
    return terms.groupBy("term").agg(F.max("a").alias("on_a"), F.max("b").alias("on_b"), F.count(F.lit(1)).alias("df")).where("on_a and on_b").select("term", "df")


def _enough(met: DataFrame, share: float) -> DataFrame:
    """(tid, own): texts that have enough terms of both sides, and how many."""
    own = met.groupBy("tid").agg(F.count(F.lit(1)).alias("own"), F.max("n").alias("words"))
    return own.where(F.col("own") >= _least_common(F.col("words"), share)).select("tid", "own")


def near_candidates(texts: DataFrame, share: float = WORD_SHARE) -> DataFrame:
    """(ta, tb): pairs of distinct ``texts`` (tid, norm, a, b), a on one side, b on the other, that may be alike."""
    # the first rounds move hashes only; each makes the terms of the texts that are left anew
    for _ in range(ROUNDS - 1):
        bare = term_lists(texts, places=False)
        kept = _enough(bare.select("tid", "n", "term").join(_used(bare).select("term"), "term", "left_semi"), share)
        texts = cut_lineage(texts.join(kept.select("tid"), "tid", "left_semi"))
    terms = term_lists(texts)
    met = terms.join(_used(terms), "term")
    met = cut_lineage(met)
    met = met.join(_enough(met, share), "tid")
    order = Window.partitionBy("tid").orderBy("df", "term")
    # terms of one side stand before the shared ones, so these fill what is left of the list
    size = F.col("own") - _least_common(F.col("n"), share) + DEPTH
    lists = cut_lineage(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size))
    x = lists.where("a").select("term", F.col("tid").alias("ta"), F.col("n").alias("na"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    y = lists.where("b").select("term", F.col("tid").alias("tb"), F.col("n").alias("nb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    k = _changes(F.greatest("na", "nb"), share)
    fits = (
        (F.col("ta") != F.col("tb")) & (F.abs(F.col("na") - F.col("nb")) <= k) & (F.col("la") - k <= F.col("hb")) & (F.col("lb") - k <= F.col("ha"))
    )
    met_pairs = x.join(y, "term").where(fits).groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("common"), F.max("na").alias("na"))
    return met_pairs.where(F.col("common") >= F.least(F.lit(DEPTH), _least_common(F.col("na"), share))).select("ta", "tb")


def cross_split_pairs(records: DataFrame, key: str, text: str, side: Column, share: float = WORD_SHARE) -> DataFrame:
    """(key_left, key_right, kind, cosine): pairs of a record with ``side`` true and one with ``side`` false.

    ``kind`` is 'exact' where the comparable texts are equal, else 'near'. Texts are told apart by 128 bits of hash.
    """
    base = records.select(F.col(key).cast("long").alias("rid"), side.alias("train"), comparable(F.col(text)).alias("norm")).where(
        F.col("norm").isNotNull() & (F.col("norm") != "") & F.col("train").isNotNull() & F.col("rid").isNotNull()
    )
    base = cut_lineage(base.select("rid", "train", "norm", F.xxhash64("norm").alias("h1"), F.xxhash64(F.reverse("norm")).alias("h2")))
    texts = base.groupBy("h1", "h2").agg(
        F.min(F.struct("rid", "train", "norm")).alias("m"), F.max("train").alias("a"), F.max(~F.col("train")).alias("b")
    )
    # the least record that holds a text names it; its first text does, if it has several
    texts = cut_lineage(texts.select("h1", "h2", F.xxhash64("h1", "h2", "m.rid").alias("tid"), F.col("m.norm").alias("norm"), "a", "b"))
    members = base.select("rid", "train", "h1", "h2").distinct().join(texts.select("h1", "h2", "tid"), ["h1", "h2"]).select("rid", "train", "tid")
    members = cut_lineage(members)
    near = near_candidates(texts.select("tid", "norm", "a", "b"), share)
    with_text = near.join(texts.select(F.col("tid").alias("ta"), F.col("norm").alias("na")), "ta").join(
        texts.select(F.col("tid").alias("tb"), F.col("norm").alias("nb")), "tb"
    )

    def confirm(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            if alike(r["na"], r["nb"], share):
                yield r["ta"], r["tb"], "near", cosine(r["na"], r["nb"])

    linked = arrow_pass(with_text, confirm, "ta long, tb long, kind string, cosine double")
    same = texts.where(F.col("a") & F.col("b")).select(
        F.col("tid").alias("ta"), F.col("tid").alias("tb"), F.lit("exact").alias("kind"), F.lit(1.0).alias("cosine")
    )
    links = linked.unionAll(same)
    one = members.where("train").select(F.col("tid").alias("ta"), F.col("rid").alias("key_left"))
    two = members.where("not train").select(F.col("tid").alias("tb"), F.col("rid").alias("key_right"))
    return links.join(one, "ta").join(two, "tb").select("key_left", "key_right", "kind", "cosine")


_CONTENT = r"(?s)Citation Content:\s*(.*)$"


def user_contents(messages: str = "messages") -> Column:
    """Citation contents of a chat record: what follows 'Citation Content:' in each user turn; an empty array without one."""
    turns = F.filter(F.col(messages), lambda m: (F.lower(F.trim(m["role"])) == "user") & m["content"].contains("Citation Content:"))
    return F.coalesce(F.transform(turns, lambda m: F.regexp_extract(m["content"], _CONTENT, 1)), F.array().cast("array<string>"))
