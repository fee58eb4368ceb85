"""The n-gram join against brute force on groups of copies, chains of near copies and shared passages."""

import random

from lakewarden.llm import ngramjoin
from lakewarden.llm.components import components


def truth(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        runs = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([tuple(w)] if w else [])
        sets[d] = set(runs)
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 4)))
    passage = [word() for _ in range(60)]
    texts = {}
    for _ in range(40):  # groups of near copies that drift, so that some links are chains
        base = [word() for _ in range(r.randint(12, 160))]
        for _ in range(r.randint(1, 9)):
            base = list(base)
            for _ in range(r.randint(0, 2)):
                base[r.randrange(len(base))] = word()
            texts[len(texts)] = " ".join(base)
    for _ in range(60):  # a passage that many share, with a short own part
        texts[len(texts)] = " ".join([word() for _ in range(r.randint(1, 30))] + passage)
    for t in ("", None, "one", "One", "two words", "a b c d", "A  b\tc\nd", "  ", "x " * 3000):
        texts[len(texts)] = t
    return texts


def test_components_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(spark, docs, percent, width).collect()}
        assert got == truth(texts, width, percent)


def test_tokens_cut_into_runs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "RUN_ROWS", 1)
    monkeypatch.setattr(ngramjoin, "CELLS", 1 << 6)
    monkeypatch.setattr(ngramjoin, "BLOCK_CELLS", 1 << 4)
    texts = corpus(7)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(spark, docs).collect()}
    assert got == truth(texts, 4, 85)


def test_no_rows_no_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.linked(spark, empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = ngramjoin.linked(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(3, None)]


def test_parity_never_passes_the_difference():
    import numpy as np

    g = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(g.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.append(a[: g.integers(1, 300)], g.integers(0, 2**63, g.integers(0, 50)).astype(np.uint64)))
        flips = int(np.bitwise_count((ngramjoin.parity(a) ^ ngramjoin.parity(b)).view(np.uint64)).sum())
        assert flips <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 99), (99, 100)], "u long, v long")
    got = dict(components(spark, edges).collect())
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 99}
