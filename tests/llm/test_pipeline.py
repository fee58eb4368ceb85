"""Stages of the corpus pipeline: near copies against brute force, ids against a tokenizer library."""

import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from lakewarden.llm.bpe import read_ranks
from test_join import corpus, truth

SCHEMA = "doc_id long, source string, text string"


def test_near_copies_keep_the_smallest_of_each_group(spark):
    texts = corpus(8)
    docs = spark.createDataFrame([(d, "a", t) for d, t in texts.items()], SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, "")
    expected = truth(texts, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, (_, c) in expected.items() if c == d)


def test_ids_equal_the_library(spark):
    import base64

    content = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Über 12345 größere Wörter,\n\n  naïve 漢字 🙂🙂", "unquestionablyinterlinked" * 40, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in corpus_pipeline.byte_bpe(spark, docs, "").collect()}
    for i, text in enumerate(texts):
        ids = known.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
