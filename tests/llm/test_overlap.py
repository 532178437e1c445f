import random

from pyspark.sql import functions as F

from colophon.llm.overlap import alike, cross_split_pairs, user_contents


def test_pair_within_one_word_in_eight_is_found_among_many_texts(spark):
    # 24 words of a template that all texts share; the pair differs in 3 of them, by words of no other text
    words = [f"word{i}" for i in range(24)]
    changed = [f"rare{i}" if i in (5, 12, 19) else w for i, w in enumerate(words)]
    other = [f"word{i}" if i % 2 else "x{n}" + f"y{i}" for i in range(24)]
    ids = spark.range(1, 3001).select(
        F.col("id").alias("rid"), F.lit("train").alias("split"),
        F.concat(F.lit(" ".join(words)), F.lit(" "), F.concat_ws(" ", *[F.concat(F.lit(f"tail{i}n"), F.col("id")) for i in range(24)])).alias("text"),
    )
    pair = spark.createDataFrame([(100001, "train", " ".join(words)), (100002, "test", " ".join(changed)), (100003, "test", " ".join(other))], ids.schema)
    found = cross_split_pairs(ids.unionAll(pair), "rid", "text", F.col("split") == "train").select("key_left", "key_right", "kind").collect()
    assert [tuple(r) for r in found] == [(100001, 100002, "near")]


def variants(n=260):
    """Short and long texts from few words, so that triples repeat, and edits of some of them."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(9)]
    rows, texts = [], []
    for i in range(n):
        if texts and draw.random() < 0.6:
            t = list(draw.choice(texts))
            for _ in range(draw.choice([0, 1, 1, 2, 3, 5])):
                at, kind = draw.randrange(len(t) + 1), draw.randrange(3)
                t[at : at + (kind > 0)] = [draw.choice(words)] if kind < 2 else []
        else:
            t = [draw.choice(words) for _ in range(draw.choice([3, 4, 5, 6, 7, 9, 14, 15, 21, 30, 42]))]
        if t:
            texts.append(t)
            rows.append((i, draw.choice(["train", "test"]), draw.choice([" ", "  ", ", "]).join(t).title() + draw.choice(["", ".", "!"])))
    return rows


def test_all_pairs_that_a_word_comparison_takes_are_found(spark):
    rows = variants()
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    wanted = {(a, b) for a, s, t in rows if s == "train" for b, z, u in rows if z == "test" and (norm(t) == norm(u) or alike(norm(t), norm(u)))}
    found = cross_split_pairs(spark.createDataFrame(rows, "rid long, split string, text string"), "rid", "text", F.col("split") == "train").collect()
    assert {(r["key_left"], r["key_right"]) for r in found} == wanted and len(wanted) > 50
    assert len(found) == len(wanted)


def test_null_blank_and_repeated_records(spark):
    rows = [(1, "train", "One two, three four five."), (1, "train", "One two, three four five."), (2, "test", "one  two three four FIVE"), (3, "test", None), (4, "test", "..."), (5, None, "one two three four five"),
            (6, "train", ""), (7, "test", "one two"), (8, "train", "one too")]
    df = spark.createDataFrame(rows, "rid long, split string, text string")
    found = [tuple(r)[:3] for r in cross_split_pairs(df, "rid", "text", F.col("split") == "train").collect()]
    assert found == [(1, 2, "exact")]
    assert cross_split_pairs(df.limit(0), "rid", "text", F.col("split") == "train").count() == 0


def test_user_turns(spark):
    cases = [[("user", "Title: x\nCitation Content: a\nb"), ("assistant", "Citation Content: no")], [], None, [("USER ", "nothing")], [("user", None), ("user", "Citation Content:c")]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, messages array<struct<role:string,content:string>>")
    assert [r["c"] for r in df.select("i", user_contents().alias("c")).orderBy("i").collect()] == [["a\nb"], [], [], [], ["c"]]
