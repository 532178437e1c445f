import numpy as np

from colophon.llm import packing, tokens

DATA = "/root/testdata/sf0.01"


def test_bm25_scores_agree_with_the_formula():
    terms = [np.array([1, 2, 5]), np.array([2, 3, 5]), np.array([1, 5, 9]), np.array([], int), np.array([5]), np.array([5])]
    freqs = [np.array([2, 1, 1]), np.array([3, 1, 1]), np.array([1, 1, 1]), np.array([], int), np.array([1]), np.array([1])]
    sizes = np.array([4, 5, 3, 0, 1, 1])
    got = packing.Bm25(terms, freqs, sizes).scores(0)
    for d in range(6):
        want = 0.0
        for t in terms[0]:
            if t in terms[d]:
                df = sum(t in x for x in terms)
                tf = freqs[d][list(terms[d]).index(t)]
                want += max(0.0, np.log((6 - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[d] / sizes.mean()))
        assert abs(got[d] - want) < 1e-9


def test_each_token_is_in_one_container_and_only_oversized_items_are_split():
    draw = np.random.default_rng(2)
    sizes = np.concatenate([draw.integers(1, 400, 300), [0, 512, 513, 2000]])
    terms = [np.unique(draw.integers(0, 500, 30)) for _ in sizes]
    index = packing.Bm25(terms, [np.ones(len(t), int) for t in terms], sizes)
    seen = [np.zeros(n, int) for n in sizes]
    for container in packing.fill(index, sizes, 512):
        assert sum(b - a for *_, a, b in container) <= 512
        for item, _, a, b in container:
            seen[item][a:b] += 1
            assert b - a == sizes[item] or sizes[item] > 512
    assert all((s == 1).all() for s in seen)


def test_neighbours_fill_the_windows_and_little_space_is_unused(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").where("lower(trim(lang)) like 'en%'")
    got = tokens.token_counts(documents, "doc_id", "text", [], terms=True).orderBy("key").collect()
    sizes = np.array([r["n_tokens"] for r in got])
    index = packing.Bm25([np.array(r["terms"]) for r in got], [np.array(r["freqs"]) for r in got], sizes)
    for capacity in (512, 2048):
        containers, ranks = packing.fill(index, sizes, capacity), []
        for container in containers:
            place = np.argsort(np.argsort(-index.scores(container[0][0])))
            ranks += [place[item] for item, *_ in container[1:]]
        assert np.median(ranks) < len(sizes) / 10
        assert 1 - sizes.sum() / len(containers) / capacity < 0.05


def test_rows_of_containers(spark):
    docs = [(1, "a b c " * 900, "en"), (2, "a b c", "EN-gb"), (3, None, "en"), (4, "", "en"), (5, "d e f", None), (6, "d e f", "de")]
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, lang string"), {"small": 512}).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 5, 6}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, lang string"), {"small": 512}).count() == 0
