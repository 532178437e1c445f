import numpy as np

from colophon.llm import mixing


def test_every_token_is_taken_at_most_so_often_and_blocks_are_full():
    for tokens, repeats in ((1000, 3), (300, 5), (40, 9), (128, 2)):
        slots = repeats * tokens // mixing.BLOCK_TOKENS
        seen, used = np.zeros((repeats, tokens), int), set()
        for n in range(slots):
            block = mixing.block_of(n, tokens, repeats, 11)
            used.add(block)
            parts = list(mixing.parts_of(block, tokens))
            assert sum(hi - lo for _, _, lo, hi in parts) == mixing.BLOCK_TOKENS
            for take, cell, lo, hi in parts:
                assert cell * mixing.BLOCK_TOKENS <= lo < hi <= (cell + 1) * mixing.BLOCK_TOKENS
                seen[take, lo:hi] += 1
        assert len(used) == slots and seen.max() <= 1


def test_shards_use_all_slots_for_totals_of_any_size():
    for totals in ([500, 130, 7], [3 * 10**9, 2 * 10**9, 10**9], [0, 5 * 10**11, 3]):
        shards = -(-sum(totals) // mixing.SHARD_SLOTS)
        last_before, last = mixing.shard_counts(totals, shards, shards - 1, 3)
        assert [a + b for a, b in zip(last_before, last, strict=True)] == totals
        before, own = mixing.shard_counts(totals, shards, shards // 2, 3)
        assert sum(own) == min(mixing.SHARD_SLOTS, sum(totals)) and sum(before) == shards // 2 * mixing.SHARD_SLOTS
        after, _ = mixing.shard_counts(totals, shards, shards // 2 + 1, 3)
        assert after == [a + b for a, b in zip(before, own, strict=True)]


def test_shares_are_met_and_null_sources_left_out(spark):
    docs = [(i, f"text {i} " * (i % 40 + 1), "ab"[i % 2] if i % 7 else "c") for i in range(600)] + [(900, None, "a"), (901, "x", None), (902, "", "b")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 2), ("m", "c", 0.2, 3), ("n", "a", 1.0, 1), ("n", "z", 1.0, 1)],
                                    "mix_name string, source string, target_share double, max_repeats int")
    chosen = mixing.mixed(documents, targets)
    report = {(r["mix_name"], r["source"]): r for r in mixing.share_report(chosen, targets).collect()}
    for source, share, most in (("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 3)):
        assert abs(report["m", source]["reached_share"] - share) < 0.01
        assert report["m", source]["most_taken"] <= most
    assert report["n", "a"]["tokens"] == 0
    taken = chosen.groupBy("mix_name", "doc_id", "take").agg({"n_tokens": "sum"}).collect()
    sizes = {r["key"]: r["n_tokens"] for r in mixing.token_counts(documents, "doc_id", "text", []).collect()}
    assert all(r["sum(n_tokens)"] <= sizes[r["doc_id"]] for r in taken)
