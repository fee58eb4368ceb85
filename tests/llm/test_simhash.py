"""SimHash: bits against a plain count, trees and components against all pairs, edge cases."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakewarden.llm import simhash
from lakewarden.llm.common import documents, only


def plain_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    """``rows``: (id, fingerprint). Smallest id per row, by all pairs of fingerprints."""
    prints = sorted({p for _, p in rows})
    up = {p: p for p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= radius:
                up[root(p)] = root(q)
    least = {}
    for i, p in rows:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for _, p in rows]


def prints_near(seed, centres, each):
    rng, out = np.random.default_rng(seed), set()
    for centre in rng.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def test_majority_counts_every_bit():
    rng = np.random.default_rng(3)
    hashes = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 2, 254, 255, 256, 511, 3000, 0)]
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hs) > hs.size) for hs in hashes]
    assert simhash.majority(hashes).tolist() == want


def test_tree_finds_all_within_the_radius():
    prints = prints_near(5, 20, 30)
    for radius in (0, 2, 5):
        who, node = simhash.BKTree(prints).search(prints, radius)
        far = np.bitwise_count(prints[:, None] ^ prints[None, :])
        assert sorted(zip(who.tolist(), node.tolist())) == sorted(zip(*[x.tolist() for x in np.nonzero(far <= radius)]))


def test_stars_of_two_parts():
    prints = prints_near(6, 12, 25)
    a, b = prints[::2], prints[1::2]
    rows = [(i, int(p)) for i, p in enumerate(prints)]
    links = [simhash.stars(*x, 2) for x in ((a, a), (b, b), (a, b))]
    number = {int(p): i for i, p in enumerate(prints)}
    u, v = (np.array([number[int(x)] for l in links for x in l[side]], np.int64) for side in (0, 1))
    assert simhash.smallest_reachable(prints.size, u, v).tolist() == plain_components(rows)


@pytest.mark.parametrize("tree, most, levels", [(4096, 16_384, 4), (4, 8, 4), (4, 8, 1)])
def test_components_at_any_shard_size(spark, monkeypatch, tree, most, levels):
    """Small limits split shards again and cut what is left into parts; results stay."""
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    prints = prints_near(7, 15, 12)
    rows = [(i, int(p)) for i, p in enumerate(prints.tolist())]
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for _, p in rows]
    found = simhash.components(spark, simhash.links(spark, spark.createDataFrame(signed, "fp long"), 2))
    label = {r.node: r.component for r in found.collect()}
    by_label = {}
    for i, (p,) in enumerate(signed):
        by_label.setdefault(label.get(p, p), set()).add(i)
    want = {}
    for i, c in enumerate(plain_components(rows)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, want.values()))


def check(spark, docs, rows):
    got = sorted((repr(r.doc_id), r.fp % (1 << 64), repr(r.component_id)) for r in simhash.grouped(spark, docs).collect())
    prints = [(i, plain_print(t)) for i, t in rows]
    want = sorted((repr(i), p, repr(c)) for (i, p), c in zip(prints, plain_components(prints)))
    assert got == want


def test_whole_table(spark, small):
    docs = only(documents(spark, small))
    check(spark, docs, [tuple(r) for r in docs.collect()])


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(4, None), (2, ""), (9, " \n"), (None, "one two three four"), (7, "One TWO three\tfour"), (7, "one two three four"),
            (None, "alone here"), (5, "ä Ä"), (6, "ä ä"), (8, long), (3, long + " more")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, label long")
    check(spark, only(docs), rows)


def test_empty_table(spark):
    assert simhash.grouped(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_columns(spark, small):
    out = simhash.op11_simhash_bk(spark, small)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert out.filter(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0
