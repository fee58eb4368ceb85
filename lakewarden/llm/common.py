"""Pieces shared by the operators: words, bound lambda values, free column names, shared files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
PYTHON_SPACE = " \t\n\x0b\x0c\r"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) and, where SQL can say the same, its statement."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def visible_to_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; harmless where it is installed."""
    import lakewarden

    root = os.path.dirname(os.path.dirname(os.path.abspath(lakewarden.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: Matches whose places are worked out together.
SPAN_BLOCK = 256


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """``start``, ``end`` (code points, end exclusive) and ``found`` of the leftmost non-overlapping matches.

    The pieces between matches and the matches themselves come from the same search, so their lengths add up to places.
    Matches that ``keep`` refuses only move the place on. Lengths are summed by blocks of ``SPAN_BLOCK`` matches first, so
    that a text of very many matches is not copied at every match. Empty for null texts and texts without a match.
    """
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    wide = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        wanted = x["found"].isNotNull() if keep is None else x["found"].isNotNull() & keep(x["found"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))
        return F.struct(end.alias("at"), F.when(wanted, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / SPAN_BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(all_, k * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)))

    def walk(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + wide(x)))
        upto = F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))

        def placed(starts: Column) -> Column:
            first = lambda i: F.struct(F.get(starts, i).alias("at"), none.alias("out"))
            return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, first(i), step, lambda state: state["out"])))

        return let(upto, placed)

    return F.when(text.rlike(pattern), let(let(zipped, cut), walk)).otherwise(none)


#: Bits a filter has for every value, and the planes they are dealt to: about 2 strings in 10,000 pass that were never put in.
BITS_A_VALUE, PLANES = 32, 4


def bit_filter(values: DataFrame, column: str, most: int) -> list[list[int]]:
    """A filter of the strings of a column as planes of longs; a string has one bit in each. ``BITS_A_VALUE`` bits a value,
    ``most`` bits at most, so that ``most`` / 64 rows come to the driver. A full filter lets more through and never loses a
    value."""
    bits = min(most, max(1024, 1 << (BITS_A_VALUE * max(1, values.count()) - 1).bit_length())) // PLANES
    places = F.array(*[F.struct(F.lit(i).alias("plane"), p.alias("place")) for i, p in enumerate(bits_of(F.col(column), bits))])
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    held = values.select(F.inline(places)).groupBy("plane", F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    out = [[0] * (bits // 64) for _ in range(PLANES)]
    for row in held.collect():
        out[row["plane"]][row["at"]] = row["bits"]
    return out


def bits_of(value: Column, bits: int) -> list[Column]:
    """The position of a string's bit in every plane of ``bits`` bits."""
    hash_ = F.xxhash64(value)
    first, step = hash_.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(hash_, 33).bitwiseOR(F.lit(1))
    return [F.pmod(first + step * i, F.lit(bits)).cast("int") for i in range(PLANES)]


def in_bits(value: Column, planes: list[list[int]]) -> Column:
    """Whether all bits of a string are set: false for sure if one of them was never put in."""
    if not any(planes[0]):
        return F.lit(False)

    def held(words: list[int], place: Column) -> Column:
        longs = F.from_json(F.lit(str(words)), "array<bigint>")  # folded to one literal
        return F.getbit(F.get(longs, F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1

    places = bits_of(value, len(planes[0]) * 64)
    return reduce(Column.__and__, map(held, planes, places))


def free_name(taken: Iterable[str], wish: str) -> str:
    """A column name that no column has yet, whatever its case."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish = "_" + wish
    return wish


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its plain name, dots included."""
    return F.col(quoted(name))


def only(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and text under fixed names, so that no other column can clash."""
    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))


def local_path(uri: str) -> str | None:
    """The path of a file: address or a plain path; None for any other store."""
    if uri.startswith("file:"):
        return re.sub(r"^file:/*", "/", uri)
    return uri if uri.startswith("/") else None


class Numbering(dict):
    """Numbers things by first appearance: ``map(numbering.__getitem__, things)``."""

    def __missing__(self, thing):
        self[thing] = number = len(self)
        return number


#: Words whose hashes a worker remembers.
KNOWN_WORDS = 400_000


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value
