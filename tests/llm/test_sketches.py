"""Fingerprints: merging, resemblance, containment and counts against exact sets, likenesses of the query against plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lakewarden.llm import fingerprints
from lakewarden.llm.common import documents, only

MASK = (1 << 64) - 1


def hashes(text):
    """Signed shingle hashes: a word's XXH64, then the words of a run one after the other, each seeded by those before."""
    words = [w for w in (text or "").encode().split()]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    runs = [one[i : i + 5] for i in range(len(one) - 4)] if len(one) >= 5 else [one] if one else []
    out = set()
    for run in runs:
        seed = 42
        for h in run:
            seed = xxhash.xxh64_intdigest((h & MASK).to_bytes(8, "little"), seed)
        out.add(seed - (1 << 64) if seed >= 1 << 63 else seed)
    return out


def plain_sketch(text, k=128):
    return sorted(hashes(text))[:k]


def plain_likeness(a, b, k=128):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else len(set(a) & set(b) & set(union)) / len(union)


def texts(seed, n, longest=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_sketches_and_their_merge(spark):
    rows = list(zip(texts(1, 40, 400), texts(2, 40, 400)))
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    both = fingerprints.merge_all(F.array(a, b, a))
    for r in df.select("a", "b", a.alias("x"), fingerprints.merge(a, b).alias("m"), both.alias("all")).collect():
        assert list(r.x) == plain_sketch(r.a)
        assert list(r.m) == list(r.all) == sorted(hashes(r.a) | hashes(r.b))[:128]


def test_parts_of_a_corpus_merge_to_its_sketch(spark):
    parts = texts(3, 60, 200)
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(parts)], "part int, text string")
    merged = df.groupBy("part").agg(F.collect_list(fingerprints.sketch(F.col("text"))).alias("s"))
    whole = merged.select(fingerprints.merge_all(F.col("s")).alias("s")).agg(F.collect_list("s").alias("s"))
    got = whole.select(fingerprints.merge_all(F.col("s")).alias("s"), fingerprints.distinct_shingles(fingerprints.merge_all(F.col("s"))).alias("n")).first()
    every = set().union(*map(hashes, parts))
    assert list(got.s) == sorted(every)[:128]
    assert got.n == pytest.approx(len(every), rel=0.3)


def test_exact_below_the_sketch_size(spark):
    """Sets whose union fits into a sketch are compared exactly."""
    rows = [(x, y) for x, y in zip(texts(4, 60, 50), texts(5, 60, 50))] + [("a b c d e f g", "a b c d e f"), ("", ""), ("", "a"), (None, "a b")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    found = df.select("a", "b", fingerprints.resemblance(a, b).alias("r"), fingerprints.containment(a, b).alias("c"), fingerprints.distinct_shingles(a).alias("n"))
    for r in found.collect():
        x, y = hashes(r.a), hashes(r.b)
        assert len(x | y) < 128 and r.n == len(x)
        assert r.r == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
        assert r.c == pytest.approx(len(x & y) / len(x) if x else 1.0)


def test_likenesses_of_the_query(spark, small):
    rows = sorted((tuple(r) for r in only(documents(spark, small)).collect()), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, small).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        own, edited, next_ = map(plain_sketch, (text, text[: len(text) - third] + after[:third], after))
        assert got[doc_id].near_edited == pytest.approx(plain_likeness(own, edited))
        assert got[doc_id].near_next == pytest.approx(plain_likeness(own, next_))
