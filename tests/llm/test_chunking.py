import random

import pytest

from colophon.llm.chunking import pieces, split_values


def text(seed, n=400):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) + draw.choice(["", "", "", ",", ".", ".\n\n"]) for _ in range(n))


@pytest.mark.parametrize("limit,overlap", [(100, 0), (200, 30), (1200, 100), (50, 49)])
def test_pieces_cover_the_text_within_the_limit_and_overlap_as_stated(limit, overlap):
    for seed in range(5):
        t = text(seed)
        cut = pieces(t, limit, overlap)
        assert cut[0][0] == 0 and cut[-1][1] == len(t) and all(0 < b - a <= limit for a, b in cut)
        assert all(a2 == max(b1 - overlap, a1 + 1) for (a1, b1), (a2, _) in zip(cut, cut[1:], strict=False))


def test_cuts_are_at_boundaries_and_an_edit_alters_only_near_pieces():
    t = text(9, 3000)
    cut = pieces(t, 1200, 0)
    assert all(t[b - 1].isspace() or t[b - 1] in ".,;" for _, b in cut[:-1])
    other = pieces(t[:6000] + "one more word " + t[6000:], 1200, 0)
    ends, moved = {b for _, b in cut}, {b if b <= 6000 else b - 14 for _, b in other}
    assert len(ends & moved) > 0.7 * len(ends)


def test_no_boundary_marks_and_bad_limits():
    assert pieces("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]
    accents = "e\u0301" * 20
    assert all(accents[b] == "e" for _, b in pieces(accents, 7, 0)[:-1])
    with pytest.raises(ValueError):
        pieces("x", 5, 5)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a" * 25, None), (1, "a" * 25, None), (2, "short", ""), (3, None, "b" * 11)], "k long, x string, y string")
    out = split_values(df, "k", {"x": (10, 2), "y": (10, 0)}).collect()
    assert sorted((r["k"], r["field_name"], r["piece_no"]) for r in out) == [(1, "x", 0), (1, "x", 1), (1, "x", 2), (3, "y", 0), (3, "y", 1)]
    assert split_values(df, "k", {"x": (10, 2)}, keep_small=True).where("k = 2").collect()[0]["piece"] == "short"
