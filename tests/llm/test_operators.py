"""Nulls, empty texts and tables, repeated rows and clashing columns; exact round trips and counts."""

import math

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import bpe, fingerprints, linededup, lm, mixing, pii, quality, secrets, sharding
from lakewarden.llm.common import bit_filter, in_bits, visible_to_workers

LINE = "this line is long enough to count as a key of its own"
ROWS = [
    (1, None, "a"), (2, "", None), (3, "one two three four five six seven eight nine ten.\n" + LINE, "a"),
    (3, "one two three four five six seven eight nine ten.\n" + LINE, "a"), (4, "x " * 20000, "b"), (None, LINE, "b"),
    *[(i, f"  {LINE.upper()} \nown {i}", "c") for i in range(10, 16)],
    (20, 'mail a@b.co ip 1.2.3.4 token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" card 4111 1111 1111 1111', "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    visible_to_workers(spark)
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_line_dedup(spark, docs, none):
    got = {(r.doc_id, r.text): r["lines"] for r in linededup.dedup_lines(spark, docs).collect()}
    assert got[1, None].n_lines == 1 and got[2, ""].n_lines == 1
    assert got[20, ROWS[-1][1]].n_dropped == 0 and got[None, LINE].n_dropped == 0
    assert [got[i, ROWS[6][1].replace("10", str(i))].n_dropped for i in range(10, 16)] == [1, 1, 1, 1, 1, 0]
    assert got[3, ROWS[2][1]].n_dropped == 1
    assert linededup.dedup_lines(spark, none).count() == 0


def test_quality_keeps_other_columns(spark, docs, none):
    clash = docs.withColumnRenamed("source", "quality")
    kept = quality.cleaned(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} >= {3, 20}
    assert quality.judged(none).count() == 0
    assert quality.repeated_words([b"a"] * 9) == 9 and quality.repeated_words([b"a", b"b"]) == 0


def test_bpe_round_trip(spark, docs, none):
    codec = bpe.public_codec(spark)
    for r in bpe.encode_documents(docs, codec).collect():
        assert bytes(r.bpe.decoded).decode() == (r.text or "") and (r.bpe.ids == []) == (not r.text)
    assert bpe.digests(none, codec).count() == 0


def test_bpe_forgets_and_learns_again(monkeypatch):
    import public_tokenizers

    content = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["unquestionablyinterlinked xyzzyplugh", None, "漢字 xyzzyplugh", "", "unquestionablyinterlinked " * 3] * 4
    fresh = [next(bpe.Vocabulary(content, public_tokenizers.PATTERN).encode([t])).tolist() for t in texts[:5]] * 4
    for bound in (0, 40, 1 << 30):
        monkeypatch.setattr(bpe, "KNOWN_BYTES", bound)
        known = bpe.Vocabulary(content, public_tokenizers.PATTERN)
        assert [ids.tolist() for a in range(0, 20, 2) for ids in known.encode(texts[a : a + 2])] == fresh


def test_shards(spark, docs, none):
    got = sharding.shard_rows(spark, docs.select("doc_id", "text"), shards=3).collect()
    assert len(got) == len(ROWS)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_rows(spark, none.select("doc_id", "text")).count() == 0


def test_mix(spark, docs, none):
    got = mixing.mixed(spark, docs.select("doc_id", "source", "text")).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    assert math.isclose(sum({r.source_size: r.target for r in got}.values()), sum(r["size"] for r in got))
    assert mixing.mixed(spark, none.select("doc_id", "source", "text")).count() == 0


def test_fingerprints(spark, docs, none):
    got = fingerprints.compared(spark, docs.select("doc_id", "text")).collect()
    assert len(got) == len(ROWS) and len({tuple(r.sketch) for r in got if r.doc_id == 3}) == 1
    assert fingerprints.compared(spark, none.select("doc_id", "text")).count() == 0


def test_spans(spark, docs, none):
    two = docs.select("doc_id", "text")
    r = next(r for r in pii.sanitised_spans(spark, two).collect() if r.doc_id == 20)
    assert [len(r[k]) for k in pii.KINDS] == [1, 1, 1, 0]
    s = next(r for r in secrets.find_secrets(two).collect() if r.doc_id == 20)["secrets"]
    assert [len(s[k]) for k in secrets.KINDS] == [1, 0, 1, 1]
    assert pii.sanitised_spans(spark, none.select("doc_id", "text")).count() == 0
    assert secrets.find_secrets(none).count() == 0


def test_allow_list_has_the_same_strings():
    import random
    import re

    old = {2: r"^[A-Za-z]*([_/=-][A-Za-z]*)*[0-9]{0,4}$", 3: r"^(/?[a-z0-9]{1,12})+(/[a-z0-9]{1,12}){2,}/?$"}
    r = random.Random(11)
    seen = {(k, fits): 0 for k in old for fits in (True, False)}
    for _ in range(2000):
        s = "".join(r.choices(r.choice(["a1/", "a1/////", "aaaaaaaaa/", "aB_/=-", "aB_/=-1", "ab1/_"]), k=r.randint(0, 13))) + r.choice(["", "12", "/ab/c1", "/"])
        for k, pattern in old.items():
            fits = re.search(pattern, s) is not None
            assert fits == (re.search(secrets.ALLOWED[k], s) is not None), s
            seen[k, fits] += 1
    assert all(n > 20 for n in seen.values())


def test_very_long_candidates(spark):
    import random

    r = random.Random(12)
    run = lambda chars, size=1 << 20: "".join(r.choices(chars, k=size))
    letters = "abcdefghijklmnopqrstuvwxyz"
    classes = {"hex": "0123456789abcdef", "one case": letters + "0123456789", "mixed case": letters + letters.upper() + "0123456789", "base64": letters + "ABC0123456789+_"}
    rows = [*classes.items(), ("digits", "0123456789")]
    patterns = [*secrets.ALLOWED, *[p for _, p, _ in secrets.CLASSES], secrets.CANDIDATE]
    big = spark.createDataFrame(
        [*[(k, run(chars)) for k, chars in rows], ("words", "a-" * (1 << 19) + "1"), ("path", "ab1/" * (1 << 18)), ("mail", "a@b" + ".c" * (1 << 19))], "k string, text string"
    ).repartition(4)
    got = {r[0]: r for r in big.select("k", pii.base_spans(big["text"])["email"].alias("mails"), *[big["text"].rlike(p) for p in patterns]).collect()}
    assert [(s.start, s.end) for s in got["mail"].mails] == [(0, (1 << 20) + 3)]
    assert got["words"][2 + 2] and got["path"][2 + 3] and not got["hex"][2 + 3] and not got["one case"][2 + 2]
    less = spark.createDataFrame([(k, run(chars, 1 << 15)) for k, chars in rows], "k string, text string").repartition(4)  # windows take their time
    found = secrets.find_secrets(less).selectExpr("k", "size(secrets.entropy) n").collect()
    assert {r.k: r.n for r in found} == {**dict.fromkeys(classes, 1), "digits": 0}


def test_disclosing_terms_count_distinct_lines(spark):
    import re
    from collections import Counter

    lines = [f"common words of line number {i}" for i in range(300)] + ["From: Jane Doe <jane@x.org>"] * 5 + ["Ask Zoltan at zz@y.org", "Zoltan wrote zz@y.org"]
    lines += [f"Contact Quill Vexley: qv@x.org ext {i}" for i in range(40)] + ["Seldom uno@z.org", "common words of abc@y.org", "common words by abc@y.org"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    mail = r"[\w.]+@[\w.]+"
    value, term, pair = Counter(), Counter(), Counter()
    distinct = set(lines)  # a line counts once, however often it is copied
    for line in distinct:
        everywhere, found = {t.lower() for t in re.findall(r"[^\W\d_]+", line)}, re.findall(mail, line)
        term.update(everywhere)
        value.update(found)
        pair.update((v, t.lower()) for v in found for t in set(re.findall(r"[^\W\d_]+", re.sub(mail, " ", line))))
    best = {}
    for (v, t), n in pair.items():
        share = math.log2(len(distinct) * n / (value[v] * term[t])) / math.log2(len(distinct) / value[v])
        if n >= 2 and share >= pii.GENERALISE:
            best[t] = max(share, best.get(t, 0))
    got = {r.term: r.share for r in pii.disclosing_terms(spark, docs).collect()}
    assert got == pytest.approx(best) and set(got) >= {"zoltan", "quill", "vexley", "ext"} and not {"common", "seldom", "jane", "doe"} & set(got)


@pytest.mark.parametrize("generalise", [pii.GENERALISE, 0.3])
def test_common_words_are_ruled_out_before_all_lines_are_counted(spark, monkeypatch, generalise):
    import re
    from collections import Counter

    lines = [f"common words of line number {i}" for i in range(400)] + [f"some words w{'abcdefgh'[i % 8]} {i}" for i in range(80)]
    lines += [f"common words by {w} of {w}@y.org {i}" for w in ("zoltan", "quill", "wa") for i in range(3)] + ["common words of line number 7"] * 50
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    mail, word = r"[\w.]+@[\w.]+", r"[^\W\d_]+"
    value, term, pair = Counter(), Counter(), Counter()
    distinct = set(lines)
    for line in distinct:
        term.update(set(re.findall(word, line)))
        value.update(re.findall(mail, line))
        pair.update((v, t) for v in re.findall(mail, line) for t in set(re.findall(word, re.sub(mail, " ", line))))
    best = {}
    for (v, t), n in pair.items():
        share = math.log2(len(distinct) * n / (value[v] * term[t])) / math.log2(len(distinct) / value[v])
        if n >= pii.SUPPORT and share >= generalise:
            best[t] = max(share, best.get(t, 0))
    asked, plain = [], pii.bit_filter

    def spied(values, column, most):
        asked.append({r[0] for r in values.select(column).collect()})
        return plain(values, column, most)

    monkeypatch.setattr(pii, "bit_filter", spied)
    got = {r.term: r.share for r in pii.disclosing_terms(spark, docs, generalise=generalise).collect()}
    assert got == pytest.approx(best) and {"zoltan", "quill"} <= set(got)
    assert {"common", "words"} <= asked[0] and set(best) <= asked[-1]
    assert generalise < pii.GENERALISE or not {"common", "words"} & asked[-1]


def test_filter_loses_no_value_and_lets_few_others_through(spark):
    values, others = (spark.range(n).selectExpr(f"concat('{w}', id) as term") for w, n in (("value", 1000), ("other", 20000)))
    passed = lambda rows, held: rows.filter(in_bits(rows["term"], held)).count()
    held, full = bit_filter(values, "term", 1 << 22), bit_filter(values, "term", 1024)
    assert passed(values, held) == passed(values, full) == 1000
    assert passed(others, held) < 40
    assert passed(others, bit_filter(values.limit(0), "term", 1 << 22)) == 0


def test_rows_of_one_id_keep_their_own_terms(spark):
    lines = [f"plain line number {i} of many" for i in range(300)] + [f"Zoltan wrote zz@y.org {i}" for i in range(3)]
    rows = [*enumerate(lines), (1000, "ask Zoltan, Zoltan"), (1000, "ask Zoltan, Zoltan"), (1000, "or ask Zoltan"), (None, "Zoltan"), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, [s.start for s in sorted([*r.generalise, *r.remove])]) for r in pii.sanitised_spans(spark, docs).collect()]
    assert len(got) == len(rows)
    assert sorted(x for i, x in got if i == 1000) == [[4, 12], [4, 12], [7]]
    assert [x for i, x in got if i is None] == [[0]] and [x for i, x in got if i == 1001] == [[]]


def test_language_model(spark, docs, none):
    got = lm.language_model(spark, docs.select("doc_id", "text")).collect()
    assert len(got) == len(ROWS) and all(r.score <= 1e-9 and r.n_known <= r.n_tokens for r in got)
    assert lm.language_model(spark, none.select("doc_id", "text")).count() == 0


def test_scores_are_plain_back_off_over_all_pairs(spark):
    from collections import Counter

    texts = {i: f"the {'cat dog cow'.split()[i % 3]} saw w{i} and w{i * 7 % 30}" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    visible_to_workers(spark)
    tokens = {i: [*t.split(), None] for i, t in texts.items()}
    train = [ts for i, ts in tokens.items() if not lm.held_out(i)]
    word, pair = Counter(w for ts in train for w in ts), Counter(p for ts in train for p in zip([None, *ts], ts))
    kept, n = Counter(), sum(word.values())
    for (c, _), k in pair.items():
        kept[c] += (k - lm.DISCOUNT) / word[c]

    def p(c, w):
        q = (pair[c, w] - lm.DISCOUNT) / word[c] if pair[c, w] else 0.0
        return q + (1 - kept[c]) * (word[w] + lm.ADD) / (n + lm.ADD * (len(word) + 1))

    got = {r.doc_id: r.score for r in lm.language_model(spark, docs).collect()}
    assert got == pytest.approx({i: sum(math.log10(p(*x)) for x in zip([None, *ts], ts)) for i, ts in tokens.items()}, rel=1e-3)


def test_spans_of_very_many_matches(spark):
    """100,000 matches in one text, at the places that a plain search gives."""
    import re

    from lakewarden.llm.common import spans

    text = "".join(f"ab{i} é" if i % 7 else f"x{i}y" for i in range(100_000))
    texts = [text, "", "no digits", "7", "a1b22c333" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = docs.select("k", spans(F.col("text"), "[0-9]+", lambda m: F.length(m) > 1).alias("s"))
    found = {r.k: [tuple(x) for x in r.s] for r in got.collect()}
    for k, t in enumerate(texts):
        assert found[k] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", t) if len(m.group()) > 1]
