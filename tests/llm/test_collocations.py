"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from lakewarden.llm import collocations
from lakewarden.llm.common import documents


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least=30, top=2000):
    counts, n = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in (1, 2, 3, 4):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in chosen.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(a, inside.get(p[i : i + m], 0))
        rows_ = []
        for p, a in chosen.items():
            if 100 * inside.get(p, 0) >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, phrase, a, l, r, n[lang], score) for i, (score, a, phrase, l, r) in enumerate(rows_[:top], start=1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string")
    return sorted(tuple(r) for r in collocations.collocations(spark, collocations.spoken(df), **options).collect())


def made_up(seed, texts=160):
    rng = random.Random(seed)
    words = ["Aa", "bb", "cc", "éé"]
    ends = [" ", " ", "\t", " ", ", ", ".\n", "\x0b", "  "]
    return [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(texts)]


@pytest.mark.parametrize("block, groups", [(1_500_000, 500_000), (150, 20)])
def test_many_blocks_and_ranges(spark, monkeypatch, block, groups):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "RANGE_GROUPS", groups)
    rows = made_up(1) + [("en", "q r s t"), ("en", "q r s t u")] * 9
    want = plain(rows, least=8)
    assert {r[2].count(" ") for r in want} == {1, 2, 3}
    assert found(spark, rows, least=8) == want


def test_top_cuts_by_score_count_and_phrase(spark):
    rows = made_up(2)
    assert found(spark, rows, least=10, top=7) == plain(rows, 10, 7)


def test_edge_cases(spark):
    rows = [(None, None), ("en", ""), ("en", "a b" * 1), ("en", " ,;. "), ("und", "x y z w v"), *[(None, "x y z w v")] * 40,
            *[("fr", "o o o o o o")] * 9, ("fr", "o " * 20000), ("es", "\x1cp\x00q r " * 35)]
    assert found(spark, rows) == plain(rows)


def test_nothing_frequent_and_empty(spark):
    assert found(spark, [("en", "one two three")]) == []
    assert collocations.collocations(spark, spark.createDataFrame([], "lang string, text string")).count() == 0


def test_scores_are_exact():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a, l, r = 3 * 10**15 + 7, 4 * 10**15 + 11, 5 * 10**15 + 13
    row = spark.createDataFrame([(a, l, r)], "f long, fw long, fz long").select(collocations._cuts(2).alias("c")).first().c
    assert row.score == 2000000 * a // (l + r)


def test_whole_table(spark, small):
    docs = collocations.spoken(documents(spark, small))
    want = plain([tuple(r) for r in docs.collect()])
    got = sorted(tuple(r) for r in collocations.op13_setm_collocations(spark, small).collect())
    assert want and got == want


def of_languages(spark, texts, words, langs):
    rng = random.Random(5)
    rows = [(langs[i % len(langs)], " ".join(f"w{int(3000 ** rng.random())}" for _ in range(words))) for i in range(texts)]
    return rows, spark.createDataFrame(rows, "lang string, text string").coalesce(1)


def test_a_language_fills_its_blocks_apart(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 1000)
    monkeypatch.setattr(collocations, "HELD_BLOCKS", 100)
    rows, docs = of_languages(spark, 160, 50, ["en", "de", "fr", "es"])
    sizes = {}
    for r in collocations.occurrences(spark, docs).orderBy("block").collect():
        sizes.setdefault(r.lang, []).append(r.n_all)
    assert all(n >= 1000 - 1000 // 50 for mine in sizes.values() for n in mine[:-1])
    assert {lang: sum(mine) for lang, mine in sizes.items()} == {lang: 2000 for lang in ("en", "de", "fr", "es")}


def test_the_heaviest_language_goes_when_many_are_open(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 300)
    rows, docs = of_languages(spark, 200, 20, ["a", "b", "c", "d", "e", "f", "a", "a"])
    blocks = collocations.occurrences(spark, docs).collect()
    assert sum(r.n_all for r in blocks) == 4000 and max(r.n_all for r in blocks) <= 300
    assert len({r.block for r in blocks}) == len(blocks) < 4000 / 100
    assert found(spark, rows, least=8) == plain(rows, least=8)


def test_pairs_travel_in_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_GROUPS", 2000)
    rows, docs = of_languages(spark, 200, 300, ["en"])
    blocks = collocations.occurrences(spark, docs)
    words = collocations.frequent_words(spark, blocks, 5)
    ranges = collocations._pair_ranges(words)
    [block] = collocations.extended(spark, blocks, words, ranges, "occurrences-2").collect()
    assert len(block.dealt) == ranges > 10 and block.groups > 10000
    assert [r.start for r in block.dealt[1:]] == [sum(collocations.unpacked(x.counts).size for x in block.dealt[: i + 1]) for i in range(ranges - 1)]
    assert sum(len(r.a) + len(r.b) + len(r.counts) for r in block.dealt) < 4 * block.groups


def test_pairs_and_numbers_come_back():
    import numpy as np

    for top in (1, 200, 70_000, 2**40):
        pairs = np.unique(np.random.default_rng(3).integers(0, top, (500, 2)), axis=0)
        back = collocations.unpaired(*collocations.paired(pairs[:, 0], pairs[:, 1]))
        assert (np.stack(back, 1) == pairs).all()
        assert (collocations.unpacked(collocations.packed(pairs[:, 1])) == pairs[:, 1]).all()
    none = np.empty(0, np.int64)
    assert [x.size for x in collocations.unpaired(*collocations.paired(none, none))] == [0, 0]
