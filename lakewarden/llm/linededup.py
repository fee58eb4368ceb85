"""Lines that repeat across documents, found with two Bloom filters and confirmed exactly.

1. Every task folds the distinct long keys of its documents into two filters: *once* (a key was seen) and *twice* (a
   key was seen again in another document). Filters of tasks merge by ``once = a | b`` and ``twice = a2 | b2 | (a & b)``,
   which is associative, so they merge block by block in a shuffle. Their size is a parameter, not a function of the data.
2. A second scan sends only suspected repeats, keys in *twice*, as 16-byte digests with their document. Rows are reduced
   per (key, document) and then per key, with partial sums, so a line that a third of all documents hold is spread first.
3. Keys of enough documents lose their lines everywhere but in the document with the largest id. The digests to drop are
   joined to the documents by id.

A filter can only suspect too much, never too little: results don't depend on its size or on which task saw what.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import col, documents, free_name, only, query
from lakewarden.session import new_scratch

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits of each filter, and bits of one of the blocks in which filters travel.
FILTER_BITS = 1 << 25
BLOCK_BITS = 1 << 18
PROBES = 2
SALTS = 32


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, A-Z lower-cased; None if shorter than ``min_chars`` code points."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def digests(text: str | None, min_chars: int) -> dict[bytes, None]:
    """Digests of the distinct long keys of a text, in order."""
    keys = (key_of(x, min_chars) for x in (text or "").encode().split(b"\n"))
    return dict.fromkeys(xxhash.xxh3_128_digest(k) for k in keys if k is not None)


def _places(found: list[bytes], bits: int) -> np.ndarray:
    """Filter positions of digests: one row of ``PROBES`` each."""
    halves = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((halves[:, :1] + steps * halves[:, 1:]) & np.uint64(bits - 1)).astype(np.int64)


def _test(filter_bytes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_bytes[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(filter_bytes: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filter_bytes, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))


def twice_seen(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS) -> bytes:
    """The *twice* filter over all documents; ``bits`` / 8 bytes come to the driver, whatever the input."""
    if bits & (bits - 1) or bits < BLOCK_BITS:
        raise ValueError(f"filter bits must be a power of two of {BLOCK_BITS} or more")
    step = BLOCK_BITS // 8

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for text in batch["text"]:
                found = list(digests(text, min_chars))
                if found:
                    places = _places(found, bits)
                    again = _test(once, places)
                    _set(twice, places[again])
                    _set(once, places)
        for block in range(0, bits // 8, step):
            part = once[block : block + step]
            if part.any():
                yield pd.DataFrame({"block": [block // step], "once": [part.tobytes()], "twice": [twice[block : block + step].tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, a, b in zip(batch["block"], batch["once"], batch["twice"]):
                once, twice = held.setdefault(block, (np.zeros(step, np.uint8), np.zeros(step, np.uint8)))
                new = np.frombuffer(a, np.uint8)
                twice |= np.frombuffer(b, np.uint8) | (once & new)
                once |= new
        for block, (_, twice) in held.items():
            yield pd.DataFrame({"block": [block], "twice": [twice.tobytes()]})

    parts = docs.select("text").mapInPandas(fold, "block int, once binary, twice binary")
    merged = parts.repartition("block").mapInPandas(merge, "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # one row per block, a number fixed by ``bits``
        out[row.block * step : (row.block + 1) * step] = np.frombuffer(row.twice, np.uint8)
    return out.tobytes()


def repeated_lines(
    spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = FILTER_BITS
) -> DataFrame:
    """``doc_id``, ``key`` of every line key that its document has to give up, exact."""
    shipped = spark.sparkContext.broadcast(twice_seen(docs, min_chars, bits))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = list(digests(text, min_chars))
                if found:
                    hit = [found[i] for i in np.flatnonzero(_test(twice, _places(found, bits)))]
                    keys += hit
                    ids += [doc_id] * len(hit)
            yield pd.DataFrame({"key": keys, "doc_id": ids})

    path = new_scratch(spark, "suspect-lines")
    docs.filter(F.col("doc_id").isNotNull()).mapInPandas(suspects, "key binary, doc_id long").write.parquet(path)
    held = spark.read.parquet(path)
    confirmed = (
        held.groupBy("key", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    # a key that very many documents hold meets its verdict in SALTS places
    salted = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["key", "salt"]).filter("doc_id <> keeper").select("doc_id", "key").distinct()


def without(text: str | None, drop: Iterable[bytes], min_chars: int) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the rest joined again."""
    lines = (text or "").encode().split(b"\n")
    drop = set(drop)
    if not drop:
        return len(lines), 0, text or ""
    stay = [x for x in lines if (k := key_of(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in drop]
    return len(lines), len(lines) - len(stay), b"\n".join(stay).decode()


def dedup_lines(
    spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    doc_id: str = "doc_id", text: str = "text", bits: int = FILTER_BITS,
) -> DataFrame:
    """All columns of ``docs``, and a struct column ``lines`` (``n_lines``, ``n_dropped``, ``kept_text``) under the first free name.

    A null text is one empty line. Documents are told apart by id: rows with one id count once and keep or lose a key
    together. Rows without an id keep all their lines and count for none.
    """
    drops = repeated_lines(spark, only(docs, doc_id, text), min_chars, min_docs, bits)
    name = free_name(docs.columns, "lines")
    mine, keys = free_name(docs.columns, "drop_for"), free_name(docs.columns, "drop_keys")
    # a document's list is no longer than its own lines
    lists = drops.groupBy(F.col("doc_id").alias(mine)).agg(F.collect_list("key").alias(keys))

    @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, dropped in batches:
            rows = [without(t, () if k is None else k, min_chars) for t, k in zip(texts, dropped)]
            yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_text"])

    joined = docs.join(lists, col(doc_id).cast("long") == F.col(mine), "left")
    return joined.withColumn(name, apply(F.coalesce(col(text), F.lit("")), F.col(keys))).drop(mine, keys)


def cleaned(spark: SparkSession, docs: DataFrame, n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """The documents without their repeated lines; columns as before, ``n_chars`` counted anew where present."""
    name = free_name(docs.columns, "lines")
    out = dedup_lines(spark, docs, text=text)
    kept = F.when(col(text).isNotNull(), col(name)["kept_text"])
    new = {text: kept, n_chars: F.length(F.coalesce(kept, F.lit(""))).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else col(c) for c in docs.columns])


ORACLE = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
  k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
  m AS (SELECT k.doc_id, i, line, c.key IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


@query("op4_line_dedup", ORACLE)
def op4_line_dedup(spark, sf_dir):
    out = dedup_lines(spark, only(documents(spark, sf_dir)))
    return out.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept_text").cast("binary"), 256).alias("kept_sha256")
    )
