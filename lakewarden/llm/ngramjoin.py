"""Jaccard join of word n-gram sets with prefix filters under several global token orders.

1. *Classes.* Documents with the same set are one class, and only classes are joined.
2. *Orders.* Every global order of tokens gives a filter: two sets that are alike enough share a token among their
   first ``n - ceil(t * n) + 1`` in that order, and ``k`` tokens among ``k - 1`` more. Order 1 puts rare tokens first (counted over all documents in a fixed
   table of cells, ties by hash), order 2 has the same counts and another tie-break, order 3 is a plain hash order.
3. *Candidates.* Prefix tokens of order 1 are exchanged once by token. In every run of one token, all classes are
   paired with one class only, so a run of any length gives one pair per row at most. That class is the one with the
   fewest rarer tokens before this one: of a group of near copies it is the one nearest to their common text, to which
   most of the others link, and all tokens of a group mostly agree on it. Pairs that meet often enough go on.
   Tokens of a full cell are cut into several runs. A class alone in its run may share the token with classes of other
   runs, so it stays, paired with nothing, until step 5 joins by token.
4. *Filters, then verification.* A pair must fit in size, token position and parity bitmaps, and share prefix tokens
   under orders 2 and 3 as well; what is left is verified on the whole sets.
5. *The rest.* Links found make components. A token whose classes all fell into one component can't add anything. On all
   other tokens the pairs across components whose bitmaps are near enough are counted in full, and those that
   share enough and weren't verified yet are, so no link between components is lost.

Frequencies only shape the orders: collisions of cells make prefixes less selective and never lose a pair. Sets travel
only for documents in a surviving pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import WordHashes, documents, only, query
from lakewarden.llm.components import components
from lakewarden.session import new_scratch

WIDTH = 4
PERCENT = 85
#: Cells of the token counts, and cells of the blocks in which they travel.
CELLS = 1 << 18
BLOCK_CELLS = 1 << 14
#: Rows of one token that one run takes, by the token's count; longer runs are split.
RUN_ROWS = 20_000
#: Bits of the filter that picks the documents whose sets are needed.
NEEDED_BITS = 1 << 23
#: Longs of a set's parity bitmap: bit ``i`` tells whether an odd number of its tokens fall on ``i``. A token that only
#: one of two sets has flips one bit, so bitmaps can't differ in more bits than the sets differ in tokens.
PARITY = 8
#: Documents whose rows a task holds before it gives them out.
SLICE_DOCS = 2500
#: Prefix tokens that a pair has to share in every order; prefixes are longer by as many less one.
SHARED = 3

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_TURN2, _TURN3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def token_set(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    x = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        x = _mixed(x ^ h[j : len(words) - size + 1 + j])
    return np.unique(x)


def signature(tokens: np.ndarray) -> int:
    """One number per set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=tokens.size)).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Of two sets that link, prefixes of this length share ``SHARED`` tokens (all of the overlap, if it is smaller)."""
    least = -(-percent * n // 100)
    return n - least + min(SHARED, least)


def _shared_enough(count: str, a_n: str, b_n: str, percent: int) -> str:
    return f"{count} >= least({SHARED}L, ceil({percent} * least({a_n}, {b_n}) / 100))"


def _rank(tokens: np.ndarray, weights: np.ndarray, order: int) -> np.ndarray:
    """Places of a set's tokens in a global order; ``tokens`` ascend, which settles ties."""
    if order == 3:
        return np.argsort(tokens * _TURN3, kind="stable")
    weight = np.minimum(weights[(tokens & np.uint64(weights.size - 1)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    turned = tokens if order == 1 else tokens * _TURN2
    return np.argsort(weight << np.uint64(40) | turned >> np.uint64(24), kind="stable")


def parity(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_PARITY = [f"odd{i}" for i in range(PARITY)]


def _near(percent: int):
    """Sets that link differ in no more tokens than this, and their bitmaps in no more bits."""
    flips = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in _PARITY)
    return F.expr(f"{100 + percent}L * ({flips}) <= {100 - percent}L * (a_n + b_n)")


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), SLICE_DOCS):
            yield batch.iloc[a : a + SLICE_DOCS]


def first_pass(spark: SparkSession, docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id``, ``n``, ``sig`` and parity of every document as a written table, and the count of every cell."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts, seen = WordHashes(), np.zeros(CELLS, np.int64), set()
        for batch in batches:
            sizes, sigs, odd, new = [], [], [], [np.empty(0, np.int64)]
            for text in batch["text"]:
                tokens = token_set(text, hashes, width)
                sig = signature(tokens)
                sizes.append(tokens.size)
                sigs.append(sig)
                odd.append(parity(tokens))
                if sig not in seen:  # copies in one task count once
                    seen.add(sig)
                    new.append((tokens & np.uint64(CELLS - 1)).astype(np.int64))
            counts += np.bincount(np.concatenate(new), minlength=CELLS)
            out = pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n": sizes, "sig": sigs, "block": -1, "counts": None})
            yield out.assign(**dict(zip(_PARITY, np.array(odd, np.int64).reshape(-1, PARITY).T)))
        for block in range(0, CELLS, BLOCK_CELLS):
            part = counts[block : block + BLOCK_CELLS].astype("<u4")
            if part.any():
                yield pd.DataFrame({"doc_id": [-1], "n": [0], "sig": [0], "block": [block // BLOCK_CELLS], "counts": [part.tobytes()]}).assign(
                    **dict.fromkeys(_PARITY, 0)
                )

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch["block"], batch["counts"]):
                held[block] = held.get(block, 0) + np.frombuffer(part, "<u4").astype(np.int64)
        for block, total in held.items():
            yield pd.DataFrame({"block": [block], "counts": [total.tobytes()]})

    path = new_scratch(spark, "sets")
    docs.mapInPandas(scan, "doc_id long, n long, sig long, block int, counts binary, " + ", ".join(f"{c} long" for c in _PARITY)).write.parquet(path)
    table = spark.read.parquet(path)
    weights = np.zeros(CELLS, np.int64)
    blocks = table.filter("block >= 0").select("block", "counts").repartition("block").mapInPandas(add, "block int, counts binary")
    for row in blocks.collect():  # CELLS / BLOCK_CELLS rows
        weights[row.block * BLOCK_CELLS : (row.block + 1) * BLOCK_CELLS] = np.frombuffer(row.counts, np.int64)
    return table.filter("block < 0").select("doc_id", "n", "sig", *_PARITY), weights


def shared_tokens(spark: SparkSession, docs: DataFrame, weights, width: int, percent: int) -> DataFrame:
    """Prefix rows (order 1) of tokens that two classes share, and all of tokens cut into runs, each with the leading class
    of its run, as a written table. ``run`` is 0 for tokens that have one run only."""

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen, weight = WordHashes(), set(), np.frombuffer(weights.value, np.int64)
        for batch in _slices(batches):
            parts, sigs, sizes, lengths = [], [], [], []
            for text in batch["text"]:
                tokens = token_set(text, hashes, width)
                sig = signature(tokens)
                if tokens.size and sig not in seen:
                    seen.add(sig)
                    p = prefix_length(tokens.size, percent)
                    parts.append(tokens[_rank(tokens, weight, 1)[:p]])
                    sigs.append(sig)
                    sizes.append(tokens.size)
                    lengths.append(p)
            if parts:
                token = np.concatenate(parts)
                lengths = np.array(lengths)
                place = np.arange(token.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                sig = np.repeat(np.array(sigs, np.int64), lengths)
                runs = weight[(token & np.uint64(CELLS - 1)).astype(np.int64)] // RUN_ROWS + 1
                yield pd.DataFrame(
                    {
                        "token": token.view(np.int64), "run": np.where(runs > 1, sig % runs + 1, 0).astype(np.int32), "sig": sig,
                        "n": np.repeat(np.array(sizes, np.int32), lengths), "place": place.astype(np.int32),
                    }
                )

    def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of token, run, place and class. Keeps one row, the first of the open run, between batches."""
        open_run = None  # its first row, and whether that row was given out
        for batch in batches:
            batch = batch.drop_duplicates(["token", "run", "sig"])
            if open_run is not None:
                first, given = open_run
                same = (batch["token"] == first["token"].iloc[0]) & (batch["run"] == first["run"].iloc[0]) & (batch["sig"] == first["sig"].iloc[0])
                batch = pd.concat([first, batch[~same]], ignore_index=True)
            else:
                given = False
                batch = batch.reset_index(drop=True)
            if batch.empty:
                continue
            token, run = batch["token"].to_numpy(), batch["run"].to_numpy()
            new = np.append(True, (token[1:] != token[:-1]) | (run[1:] != run[:-1]))
            starts = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            count = np.bincount(number)
            keep = (count[number] > 1) | (run > 0)  # the rows of a cut token may lie in other runs
            last_given = bool(keep[-1]) or (given and starts.size == 1)
            if given:
                keep[0] = False
            head = starts[number]
            out = batch[keep]
            lead = head[keep]
            if len(out):
                yield out.assign(
                    lead_sig=batch["sig"].to_numpy()[lead], lead_n=batch["n"].to_numpy()[lead], lead_place=batch["place"].to_numpy()[lead]
                )
            open_run = batch.iloc[[starts[-1]]], last_given

    rows = docs.select("text").mapInPandas(prefixes, "token long, run int, sig long, n int, place int")
    path = new_scratch(spark, "shared-tokens")
    (
        rows.repartition("token", "run")
        .sortWithinPartitions("token", "run", "place", "sig")
        .mapInPandas(repeats, "token long, run int, sig long, n int, place int, lead_sig long, lead_n int, lead_place int")
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def _fits(a: str, b: str, percent: int):
    """Size filter, and the bound on the overlap that a shared token's places leave."""
    size = f"100L * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n)"
    most = f"least({a}place, {b}place) + 1 + least({a}n - {a}place, {b}n - {b}place) - 1"
    return F.expr(f"{size} and {100 + percent}L * ({most}) >= {percent}L * ({a}n + {b}n)")


def _needed(ids: DataFrame) -> bytes:
    """A fixed filter of document ids: ``NEEDED_BITS`` / 8 bytes, made of bitmaps of 4 KB."""
    place = F.pmod(F.col("rep"), F.lit(NEEDED_BITS)) + 1
    maps = ids.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")
    )
    out = np.zeros(NEEDED_BITS // 8, np.uint8)
    for row in maps.collect():  # NEEDED_BITS / 32768 rows at most
        at = (row.bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row.bits, np.uint8)[:4096]
    return out.tobytes()


def verified(
    spark: SparkSession, docs: DataFrame, pairs: DataFrame, classes: DataFrame, weights, width: int, percent: int
) -> DataFrame:
    """The pairs of classes (``a``, ``b``) that link, as pairs of their smallest documents, in a written table."""
    if pairs.isEmpty():
        return classes.select(F.col("rep").alias("u"), F.col("rep").alias("v")).limit(0)
    sigs = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted_path = new_scratch(spark, "wanted-sets")
    classes.join(sigs, "sig", "left_semi").write.parquet(wanted_path)
    wanted = spark.read.parquet(wanted_path)
    bits = spark.sparkContext.broadcast(_needed(wanted.select("rep")))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, hashes, weight = np.frombuffer(bits.value, np.uint8), WordHashes(), np.frombuffer(weights.value, np.int64)
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            place = ids % NEEDED_BITS
            batch = batch[(held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                tokens = token_set(text, hashes, width)
                if tokens.size:
                    p = prefix_length(tokens.size, percent)
                    second, third = (tokens[_rank(tokens, weight, o)[:p]].view(np.int64) for o in (2, 3))
                    out.append((doc_id, signature(tokens), tokens.view(np.int64), second, third))
            yield pd.DataFrame(out, columns=["rep", "sig", "tokens", "second", "third"])

    schema = "rep long, sig long, tokens array<bigint>, second array<bigint>, third array<bigint>"
    sets_path = new_scratch(spark, "token-sets")
    docs.mapInPandas(fetch, schema).join(wanted, ["sig", "rep"], "left_semi").dropDuplicates(["sig"]).write.parquet(sets_path)
    sets = spark.read.parquet(sets_path)
    side = lambda s, *cols: sets.select(F.col("sig").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    alike = lambda c: F.size(F.array_intersect(f"a_{c}", f"b_{c}")) >= F.expr(
        f"least({SHARED}L, ceil({percent} * least(size(a_tokens), size(b_tokens)) / 100))"
    )
    both = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    union = F.size("a_tokens") + F.size("b_tokens") - both
    path = new_scratch(spark, "links")
    (
        pairs.join(side("a", "rep", "tokens", "second", "third"), "a")
        .join(side("b", "rep", "tokens", "second", "third"), "b")
        .filter(alike("second") & alike("third"))
        .filter(both * 100 >= union * percent)
        .select(F.col("a_rep").alias("u"), F.col("b_rep").alias("v"))
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def linked(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Null texts and texts without words have an empty set and are linked with nothing. Rows without an id are left to
    themselves and have no component. Rows with one id are linked by their own texts. An empty table gives no rows.
    """
    named = docs.filter("doc_id is not null")
    table, counts = first_pass(spark, named, width)
    weights = spark.sparkContext.broadcast(counts.tobytes())  # CELLS longs
    per_class = table.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in _PARITY])
    classes = per_class.select("sig", "rep")
    shared = shared_tokens(spark, named, weights, width, percent)
    met = (
        shared.filter("sig <> lead_sig")
        .withColumns({"a_n": F.col("lead_n"), "a_place": F.col("lead_place"), "b_n": F.col("n"), "b_place": F.col("place")})
        .filter(_fits("a_", "b_", percent))
        .groupBy(F.least("lead_sig", "sig").alias("a"), F.greatest("lead_sig", "sig").alias("b"))
        .agg(F.count("*").alias("met"), F.min(F.least("a_n", "b_n")).alias("a_n"), F.max(F.greatest("a_n", "b_n")).alias("b_n"))
        .filter(_shared_enough("met", "a_n", "b_n", percent))
    )
    bitmaps = lambda s: per_class.select(F.col("sig").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in _PARITY])
    first_pairs = met.join(bitmaps("a"), "a").join(bitmaps("b"), "b").filter(_near(percent))
    path = new_scratch(spark, "first-pairs")
    first_pairs.select("a", "b").write.parquet(path)
    tried = spark.read.parquet(path)
    links = verified(spark, named, tried, classes, weights, width, percent)
    found = components(spark, links)

    label = F.coalesce("component", "rep").alias("label")
    labels = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sig", label)
    marked_path = new_scratch(spark, "labelled-tokens")
    shared.select("token", "sig", "n", "place").join(labels, "sig").write.parquet(marked_path)
    marked = spark.read.parquet(marked_path)
    unsettled = marked.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    left_path = new_scratch(spark, "unsettled-tokens")
    marked.join(unsettled, "token", "left_semi").join(per_class.select("sig", *_PARITY), "sig").write.parquet(left_path)
    left = spark.read.parquet(left_path)
    renamed = lambda s: left.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("sig", "n", "place", "label", *_PARITY)])
    # all prefix tokens that a linked pair shares were met
    most = "met + least(a_n - a_last, b_n - b_last) - 1"
    reach = F.expr(f"{100 + percent}L * ({most}) >= {percent}L * (a_n + b_n)")
    rest_path = new_scratch(spark, "rest-pairs")
    (
        renamed("a")
        .join(renamed("b"), "token")
        .filter("a_sig < b_sig and a_label <> b_label")
        .filter(_fits("a_", "b_", percent))
        .filter(_near(percent))
        .groupBy(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"), "a_n", "b_n")
        .agg(F.count("*").alias("met"), F.max("a_place").alias("a_last"), F.max("b_place").alias("b_last"))
        .filter(_shared_enough("met", "a_n", "b_n", percent))
        .filter(reach)
        .select("a", "b")
        .join(tried, ["a", "b"], "left_anti")
        .write.parquet(rest_path)
    )
    more = verified(spark, named, spark.read.parquet(rest_path), classes, weights, width, percent)
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = components(spark, stars.unionByName(more)).withColumnRenamed("node", "rep")
    of_class = classes.join(final, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    full = table.filter("n > 0").join(of_class, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = table.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    unnamed = _unnamed(docs.filter("doc_id is null"), width)
    return full.unionByName(empty).unionByName(unnamed)


def _unnamed(docs: DataFrame, width: int) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"n_shingles": [token_set(t, hashes, width).size for t in batch["text"]]})

    none = F.lit(None).cast("long")
    return docs.select("text").mapInPandas(count, "n_shingles long").select(none.alias("doc_id"), "n_shingles", none.alias("component_id"))


def representatives(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id`` of the one document of each group that stays: the smallest."""
    return linked(spark, docs, percent, width).filter("doc_id = component_id").select("doc_id").distinct()


@query("op3_ngram_join")
def op3_ngram_join(spark, sf_dir):
    return linked(spark, only(documents(spark, sf_dir)))
