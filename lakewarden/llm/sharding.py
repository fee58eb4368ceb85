"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 128-bit key: a hash of the text, then the document id, so equal texts lie side by side and a hot
text can still be cut. Splitters start as targets in bytes. Every round counts the exact bytes in each cell of a grid of
candidate boundaries (one digit of the key at a time) inside the cells that still hold a target, and keeps the cell that
the target falls in. A target is settled when its cell holds no more than the tolerance, or nothing of the key is left.
Only cell sums reach the driver: at most ``2**DIGIT`` per open splitter and round. Then rows are exchanged once.

Places in a shard are given without bringing a shard to one task: rows are numbered inside (shard, lane), lanes by a
hash, and the lanes' counts, ``shards * lanes`` rows, say where each lane starts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lakewarden.llm.common import documents, only, query
from lakewarden.session import new_scratch, small_frame

SHARDS = 40
ROW_BYTES = 16
#: Bits of the key that one round refines, and lanes that number a shard's rows.
DIGIT = 10
LANES = 64
#: A splitter may miss its target by this share of a shard.
TOLERANCE = 0.002
#: A group of equal texts up to this share of a shard stays whole; larger ones are cut by document id.
WHOLE_GROUP = 0.05
_WORD = 64


@dataclass(frozen=True)
class Splitter:
    """Rows whose leading ``bits`` key bits are below ``prefix`` lie before it."""

    bits: int
    prefix: int


def _keys(docs: DataFrame) -> DataFrame:
    """One slim row per document: id, size, checksum and the two key words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hi"),
        F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("lo"),
    )


def _lead(bits: int) -> Column:
    """Value of the leading ``bits`` of a key word, as an unsigned number in a long (``bits`` up to 62)."""
    return F.shiftrightunsigned("hi", _WORD - bits) if bits else F.lit(0).cast("long")


def _unsigned(value: int) -> int:
    """A key word as the long that holds its bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def _below(s: Splitter) -> Column:
    """Whether a row lies before the splitter; key words compare as unsigned numbers."""
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  order of unsigned words
    at = s.prefix << (128 - s.bits)
    if at >= 1 << 128:
        return F.lit(True)
    hi, lo = at >> 64, at & ((1 << 64) - 1)
    edge_hi, edge_lo = (_unsigned(x ^ (1 << 63)) for x in (hi, lo))
    mine_hi, mine_lo = flip(F.col("hi")), flip(F.col("lo"))
    if not lo:
        return mine_hi < F.lit(edge_hi)
    return (mine_hi < F.lit(edge_hi)) | ((mine_hi == F.lit(edge_hi)) & (mine_lo < F.lit(edge_lo)))


def _cell(bits: int) -> Column:
    """Text of the leading ``bits`` key bits: equal texts, equal cells. Decimal digits of the two words."""
    if bits <= 62:
        return _lead(bits).cast("string")
    if bits <= 64:
        return F.col("hi").cast("string")
    return F.concat(F.col("hi").cast("string"), F.lit("/"), F.shiftrightunsigned("lo", 128 - bits).cast("string"))


def _cell_of(bits: int, prefix: int) -> str:
    """``_cell`` of a known prefix."""
    if bits <= 62:
        return str(prefix)
    if bits <= 64:
        return str(_unsigned(prefix << (64 - bits)))
    return f"{_unsigned(prefix >> (bits - 64))}/{_unsigned(prefix & ((1 << (bits - 64)) - 1)) if bits == 128 else prefix & ((1 << (bits - 64)) - 1)}"


def _next_bits(bits: int, first_low: int) -> int:
    """The key length of the next round; word borders are stopped at, and id bits that no row sets are passed over."""
    if bits < 60:
        return bits + DIGIT
    if bits < 64:
        return 64
    return min(128, max(bits, first_low) + DIGIT)


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Splitter]:
    """``shards - 1`` splitters at equal bytes; ``rows`` has ``size``, ``hi`` and ``lo``."""
    total, low = rows.agg(F.sum("size"), F.max(F.col("lo").bitwiseXOR(F.lit(-(1 << 63))))).first()
    if not total:
        return [Splitter(0, 1)] * (shards - 1)
    # ids are never negative as a rule, and then their leading zero bits need no rounds of their own
    top = (low ^ (1 << 63)) if low >= 0 else low + (1 << 63)
    negative = rows.filter("lo < 0").limit(1).count() > 0
    first_low = 64 if negative else 128 - max(1, int(top).bit_length())
    slack = max(1, int(total * tolerance / shards))
    group = max(slack, int(total * WHOLE_GROUP / shards))
    targets = {i: total * (i + 1) // shards for i in range(shards - 1)}
    #: splitter -> (bits, prefix, bytes below the cell)
    where = dict.fromkeys(targets, (0, 0, 0))
    settled: dict[int, Splitter] = {}
    while targets:
        bits = where[next(iter(targets))][0]
        then = _next_bits(bits, first_low)
        open_cells = {where[i][:2] for i in targets}
        held = rows
        if bits:
            held = rows.filter(_cell(bits).isin([_cell_of(*c) for c in open_cells]))
        # at most 2**(then - bits) cells of each open cell: a fixed number
        digit = _digit(bits, then)
        found: dict[str, dict[int, int]] = {}
        for cell, d, size in held.groupBy(_cell(bits).alias("cell"), digit.alias("digit")).agg(F.sum("size")).collect():
            found.setdefault(cell, {})[d] = size
        for i in list(targets):
            _, prefix, below = where[i]
            cells = found[_cell_of(bits, prefix) if bits else "0"]
            jump = then - bits
            for d in sorted(cells):
                if below + cells[d] > targets[i]:
                    break
                below += cells[d]
            else:
                d, below = max(cells), below - cells[max(cells)]
            inner = (prefix << jump) | d
            if cells[d] <= (group if then == 64 else slack) or then == 128:
                # the nearer end of a cell that no longer matters
                after = 2 * (targets[i] - below) > cells[d]
                settled[i] = Splitter(then, inner + after)
                del targets[i]
            else:
                where[i] = (then, inner, below)
    return [settled[i] for i in range(shards - 1)]


def _digit(bits: int, then: int) -> Column:
    """Value of the key bits from ``bits`` to ``then``."""
    if then <= 64:
        width = then - bits
        return F.shiftrightunsigned("hi", 64 - then).bitwiseAND(F.lit((1 << width) - 1)).cast("long")
    start = max(bits, 64)
    width = then - start
    mask = F.lit((1 << width) - 1) if width < 63 else F.lit(-1)
    return F.shiftrightunsigned("lo", 128 - then).bitwiseAND(mask).cast("long")


def _shard_of(cuts: list[Splitter], low: int, high: int) -> Column:
    """Number of splitters at or below a row's key, by halving."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(_below(cuts[mid]), _shard_of(cuts, low, mid)).otherwise(_shard_of(cuts, mid + 1, high))


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, lanes: int = LANES) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row of ``docs`` (``doc_id``, ``text``).

    Null texts count as empty ones, null ids sort as 0. Repeated rows are placed each; which of two equal rows gets
    which slot can't be told apart. An empty table gives no rows.
    """
    path = new_scratch(spark, "shard-keys")
    _keys(docs).write.parquet(path)
    rows = spark.read.parquet(path)
    cuts = splitters(rows.select("size", "hi", "lo"), shards)
    lane = F.pmod(F.xxhash64("hi", "lo"), F.lit(lanes)).cast("int")
    placed = rows.select("*", _shard_of(cuts, 0, shards - 1).cast("int").alias("shard"), lane.alias("lane"))
    counts = sorted(tuple(r) for r in placed.groupBy("shard", "lane").count().collect())  # shards * lanes rows at most
    starts, shard, at = [], None, 0
    for s, n, c in counts:
        at = 0 if s != shard else at
        starts.append((s, n, at))
        shard, at = s, at + c
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("lane", T.IntegerType()), T.StructField("start", T.LongType())])
    offsets = small_frame(spark, starts, schema)
    order = Window.partitionBy("shard", "lane").orderBy("hi", "lo", "size", "text_crc32")
    return (
        placed.withColumn("row", F.row_number().over(order))
        .join(F.broadcast(offsets), ["shard", "lane"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("row") - 1).cast("long").alias("slot"))
    )


@query("op6_histogram_shards")
def op6_histogram_shards(spark, sf_dir):
    out = shard_rows(spark, only(documents(spark, sf_dir)))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
