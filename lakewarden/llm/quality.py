"""Quality rules, line first: lines fail one by one, and a document goes when failing lines hold too much of its text.

A line with words fails when it

* is punctuation: more than ``max_marks`` of the marks ``#*$%&|<>`` per 100 words, more than ``max_bangs`` exclamation
  marks per 100 words (three at least), or fewer than ``short_line`` words without closing punctuation;
* is navigation: two separators (``|``, ``»``, ``›``, ``•``, ``·``) or more, and more than ``max_separators`` per 100 words;
* is boilerplate: it holds one of the phrases in ``BOILERPLATE``.

Failing lines are removed. A document is rejected when they held more than ``max_lost`` percent of its word characters.
The base verdict (too few words, or too many words in repeated windows) rejects before that.

Everything is local to a row: no shuffle, and memory follows one batch of texts. Repeated windows are counted with
exact integer ranks of words and word pairs, so a very long text costs sorted arrays and no tuples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import Numbering, col, documents, free_name, only, query

#: Phrases of page furniture, ASCII, any case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "uses cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "lorem ipsum",
)
CLOSING = ".!?:;\"')]…”’»。！？"
SEPARATORS = "|»›•·"
MARKS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 10
    max_repeated: int = 20
    max_marks: int = 30
    max_bangs: int = 30
    max_separators: int = 20
    short_line: int = 4
    max_lost: int = 30


RULES = LineRules()
FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines long, n_failed_lines long, lost_chars long, kept boolean, clean_text string"
)

_MARKS = re.compile(b"[" + re.escape(MARKS).encode() + b"]")
_SEPARATORS = re.compile("|".join(map(re.escape, SEPARATORS)).encode())
_PHRASES = tuple(p.encode() for p in BOILERPLATE)
_CLOSED = tuple(c.encode() for c in CLOSING)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more; exact."""
    n = len(words)
    if n <= window:
        return 0
    number = Numbering()
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    ranks = ids
    for size in range(2, window + 1):
        distinct, ranks = np.unique(ranks[:-1] * len(number) + ids[size - 1 :], return_inverse=True)
        if distinct.size == ranks.size:
            return 0
    starts = np.bincount(ranks)[ranks] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def has_phrase(text: bytes) -> bool:
    low = text.lower()
    return any(p in low for p in _PHRASES)


def line_fails(line: bytes, n: int, rules: LineRules, phrases: bool = True) -> bool:
    """The verdict on a line of ``n`` words, one at least; ``phrases`` is False where none is in the whole text."""
    if 100 * len(_MARKS.findall(line)) > rules.max_marks * n:
        return True
    bangs = line.count(b"!")
    if bangs >= 3 and 100 * bangs > rules.max_bangs * n:
        return True
    if n < rules.short_line and not line.rstrip().endswith(_CLOSED):
        return True
    separators = len(_SEPARATORS.findall(line))
    if separators >= 2 and 100 * separators > rules.max_separators * n:
        return True
    return phrases and has_phrase(line)


def _chars(words: list[bytes]) -> int:
    joined = b"".join(words)
    return len(joined) if joined.isascii() else len(joined.decode())


def judge(text: str | None, rules: LineRules = RULES) -> tuple:
    """One row of ``FEATURES`` for one text; a null text is an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    n, total = len(words), _chars(words)
    seen: set[bytes] = set()
    kept, dups, failed, lost, lines = [], 0, 0, 0, 0
    phrases = has_phrase(raw)
    for line in raw.split(b"\n"):
        lines += 1
        own = line.split()
        if own:
            if line in seen:
                dups += 1
            else:
                seen.add(line)
            if line_fails(line, len(own), rules, phrases):
                failed += 1
                lost += _chars(own)
                continue
        kept.append(line)
    repeated = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeated > rules.max_repeated * n
    keep = not base_failed and 100 * lost <= rules.max_lost * total
    clean = b"\n".join(kept).decode() if failed else (text or "")
    return (n, total, len(_MARKS.findall(raw)), dups, repeated, base_failed, lines, failed, lost, keep, clean)


def judged(docs: DataFrame, rules: LineRules = RULES, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and a struct column ``quality`` of ``FEATURES`` under the first free name.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged each.
    """

    @F.pandas_udf(FEATURES)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in FEATURES.split(",")]
        for texts in batches:
            yield pd.DataFrame([judge(t, rules) for t in texts], columns=names)

    return docs.withColumn(free_name(docs.columns, "quality"), verdict(F.coalesce(col(text), F.lit(""))))


def cleaned(docs: DataFrame, rules: LineRules = RULES, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The kept documents with their failing lines removed; columns as before, ``n_chars`` counted anew where present.

    A null text never comes through: it has no words.
    """
    name = free_name(docs.columns, "quality")
    out = judged(docs, rules, text).filter(col(name)["kept"])
    new = {text: col(name)["clean_text"], n_chars: F.length(col(name)["clean_text"]).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else col(c) for c in docs.columns])


def _oracle() -> str:
    """The same rules in SQL; sets and phrases from the constants above."""
    quote = lambda s: s.replace("'", "''")
    phrases = " OR ".join(f"contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{quote(p)}')" for p in BOILERPLATE)
    closed = ", ".join(f"'{quote(c)}'" for c in CLOSING)
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    count = lambda chars, of: f"(length({of}) - length(translate({of}, '{quote(chars)}', '')))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
  p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
  g AS (SELECT doc_id, i, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram
        FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE i <= n - 4),
  r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE c > 1 GROUP BY doc_id),
  l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
  m AS (SELECT doc_id, line, len(regexp_extract_all(line, '{word}')) AS n, length(regexp_replace(line, '{space}+', '', 'g')) AS chars FROM l),
  f AS (SELECT *, 100 * {count(MARKS, 'line')} > {RULES.max_marks} * n
          OR ({count('!', 'line')} >= 3 AND 100 * {count('!', 'line')} > {RULES.max_bangs} * n)
          OR (n < {RULES.short_line} AND right(regexp_replace(line, '{space}+$', ''), 1) NOT IN ({closed}))
          OR ({count(SEPARATORS, 'line')} >= 2 AND 100 * {count(SEPARATORS, 'line')} > {RULES.max_separators} * n)
          OR {phrases} AS bad FROM m WHERE n > 0),
  s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM f GROUP BY doc_id),
  b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{space}+', '', 'g'))::BIGINT AS word_chars,
          {count(MARKS, 't')}::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
          coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost
        FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
  v AS (SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeated} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {RULES.max_lost} * word_chars AS kept FROM v"""


@query("op2_line_quality", _oracle())
def op2_line_quality(spark, sf_dir):
    out = judged(only(documents(spark, sf_dir)))
    return out.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )
