"""Near copies by SimHash: fingerprints that differ in few bits link, found in BK-trees.

1. *Fingerprints.* A bit of a text's fingerprint is 1 if it is set in over half of the hashes of the text's shingles.
   Bits are counted for many texts at once, 255 hashes at a time in byte lanes. Equal fingerprints are one node.
2. *Shards.* Two fingerprints within ``RADIUS`` bits agree on all bits of at least one of ``RADIUS + 1`` disjoint sets of
   bits. Every fingerprint goes to one shard per set: that of its first bits there, as many as make shards of about
   ``TREE`` fingerprints. Shards above ``MOST`` are split in the same way by their other bits; what is still too large
   after ``LEVELS`` splits is cut into parts, and every part is searched from all parts of its shard.
3. *BK-trees.* A shard's tree hangs every fingerprint below a parent by its distance to it. A search goes down from the
   root and follows only edges within ``RADIUS`` of its own distance to a node; many searches go down together.
   A shard's tree is sent to the searches of that shard and not to every task, since all trees together grow with the
   corpus. Work per fingerprint is the same at any size of the corpus.
4. *Components.* A search gives out one link per fingerprint of a group that it connects, not every pair.

Null texts are texts without words; their fingerprint is zero and links like any other. Very long texts cost memory in
proportion to the longest one. Repeated rows and ties have one fingerprint. Rows without an id take part in linking and
count for no smallest id: a component that has no id at all has none. An empty table gives no rows. Other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import documents, only, query
from lakewarden.llm.components import components
from lakewarden.session import new_scratch

WIDTH = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a shard that are aimed at, and most of them before a shard is split again.
TREE, MOST = 4096, 16_384
LEVELS = 4
#: Searches that go down a tree together.
TOGETHER = 4096
#: Hashes of one slice of texts.
SLICE_HASHES = 400_000

#: Byte lanes: bit ``i`` of a byte as byte ``i`` of a long.
_LANES = np.array([sum(1 << (8 * i) for i in range(8) if v >> i & 1) for v in range(256)], np.uint64)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Unsigned XXH64 of every run of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, SEED) for r in runs), np.uint64, max(1, len(words) - width + 1))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint of every array of hashes; zero for an empty one."""
    sizes = np.array([h.size for h in hashes], np.int64)
    out = np.zeros(sizes.size, np.uint64)
    full = np.flatnonzero(sizes)
    if not full.size:
        return out
    sizes = sizes[full]
    octets = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    lots = -(-sizes // 255)  # so many hashes fill no byte lane
    first_lot = np.cumsum(lots) - lots
    inside = np.arange(lots.sum()) - np.repeat(first_lot, lots)
    starts = np.repeat(np.cumsum(sizes) - sizes, lots) + 255 * inside
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts = np.add.reduceat(lanes[:, i].astype(np.int64), first_lot)
            out[full] |= (2 * counts > sizes).astype(np.uint64) << np.uint64(8 * j + i)
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and ``fp``, a fingerprint as a signed long, of every row of ``docs`` (``doc_id``, ``text``)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            waiting, held, parts = [], 0, []
            for text in batch["text"]:
                waiting.append(shingle_hashes(text, width))
                held += waiting[-1].size
                if held >= SLICE_HASHES:
                    parts.append(majority(waiting))
                    waiting, held = [], 0
            parts.append(majority(waiting))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.concatenate(parts).view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, fp long")


class BKTree:
    """Distinct fingerprints, each below its parent by the distance between the two."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.child = np.full((prints.size, 65), -1, np.int32)
        waiting = np.arange(1, prints.size)
        parent = np.zeros(waiting.size, np.int64)
        while waiting.size:  # one level of the tree a turn: the first to come by an edge stays, the others go on below it
            edge = parent * 65 + np.bitwise_count(prints[waiting] ^ prints[parent])
            taken, first, back = np.unique(edge, return_index=True, return_inverse=True)
            self.child[taken // 65, taken % 65] = waiting[first]
            below = np.ones(waiting.size, bool)
            below[first] = False
            parent, waiting = waiting[first][back][below], waiting[below]

    def search(self, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``wanted`` and in the tree of all fingerprints within ``radius`` of each other."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for a in range(0, wanted.size if self.prints.size else 0, TOGETHER):
            who = np.arange(a, min(a + TOGETHER, wanted.size))
            node = np.zeros(who.size, np.int64)
            while who.size:
                far = np.bitwise_count(wanted[who] ^ self.prints[node]).astype(np.int64)
                near = far <= radius
                found.append((who[near], node[near]))
                edges = far[:, None] + np.arange(-radius, radius + 1)
                below = np.where((edges > 0) & (edges <= 64), self.child[node[:, None], np.clip(edges, 0, 64)], -1)
                row, column = np.nonzero(below >= 0)
                who, node = who[row], below[row, column].astype(np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def smallest_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over links ``u``, ``v``."""
    label = np.arange(n)
    while u.size:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new[u], new[v]):
            return new[label]
        label = new[label]
    return label


def stars(tree: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from fingerprints of either array to one of their group; arrays hold no fingerprint twice."""
    both = tree if wanted is tree else np.concatenate([tree, wanted])
    who, node = BKTree(tree).search(wanted, radius)
    who = who + (both.size - wanted.size)
    other = who != node
    label = smallest_reachable(both.size, who[other], node[other])
    moved = np.flatnonzero(label != np.arange(both.size))
    return both[moved], both[label[moved]]


@lru_cache(maxsize=1 << 16)
def bit_sets(used: int, bits: int, radius: int) -> tuple[int, ...]:
    """``radius`` + 1 masks: ``used`` and the first ``bits`` unused bits of each of as many disjoint sets."""
    free = [i for i in range(64) if not used >> i & 1]
    per = len(free) // (radius + 1)
    sets = [free[j * per : (j + 1) * per] for j in range(radius + 1)]
    return tuple(used | sum(1 << i for i in s[:bits]) for s in sets)


def dealt(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (``used``, ``value``, ``fp``, ``n``: fingerprints of the shard) dealt to shards by bits not used yet."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            used = batch["used"].to_numpy(np.int64).view(np.uint64)
            bits = np.ceil(np.log2(np.maximum(batch["n"].to_numpy(np.float64) / TREE, 2))).astype(np.int64)
            kinds, back = np.unique(np.stack([used, bits.astype(np.uint64)], 1), axis=0, return_inverse=True)
            masks = np.array([bit_sets(int(u), int(b), radius) for u, b in kinds], np.uint64).reshape(-1, radius + 1)[back.reshape(-1)]
            for j in range(radius + 1):
                yield pd.DataFrame({"used": masks[:, j].view(np.int64), "value": (fp & masks[:, j]).view(np.int64), "fp": fp.view(np.int64)})

    return rows.mapInPandas(deal, "used long, value long, fp long")


def _kept(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = new_scratch(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def shards(spark: SparkSession, distinct: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """``used``, ``value``, ``part``, ``prints`` of every shard of the fingerprints ``fp``, and about how many there are."""
    total = distinct.count()
    rows = distinct.select(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("value"), "fp", F.lit(total).alias("n"))
    ready, many = [], 1
    for level in range(LEVELS + 1):
        large = rows.filter(F.col("n") > MOST)
        last = level == LEVELS or (total <= MOST if level == 0 else large.isEmpty())
        ready.append(rows if last else rows.filter(F.col("n") <= MOST))
        if last:
            break
        keyed = _kept(spark, dealt(large, radius), "simhash-shards")
        sizes = keyed.groupBy("used", "value").agg(F.count("*").alias("n"))
        many += (radius + 1) * total // TREE
        rows = keyed.join(sizes, ["used", "value"]).filter("n > 1")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    parts = F.ceil(F.col("n") / MOST)
    every = every.withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    packed = every.groupBy("used", "value", "part").agg(F.sort_array(F.collect_list("fp")).alias("prints"))  # about MOST at most
    return packed, many


def links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u``, ``v``: links that join all fingerprints ``fp`` within ``radius`` bits, and all that these reach."""
    packed, many = shards(spark, distinct, radius)
    trees = _kept(spark, packed, "simhash-trees")
    tree = trees.select("used", "value", F.col("part").alias("tree_part"), F.col("prints").alias("tree"))
    pairs = trees.join(tree, ["used", "value"]).filter("tree_part <= part").withColumn("own", F.col("tree_part") == F.col("part"))
    pairs = pairs.select("own", "prints", F.when(~F.col("own"), F.col("tree")).alias("tree"), "used", "value", "part", "tree_part")
    pairs = pairs.repartition(max(spark.sparkContext.defaultParallelism, many // 8), "used", "value", "part", "tree_part")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, prints, tree in zip(batch["own"], batch["prints"], batch["tree"]):
                wanted = np.asarray(prints, np.int64).view(np.uint64)
                u, v = stars(wanted if own else np.asarray(tree, np.int64).view(np.uint64), wanted, radius)
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.select("own", "prints", "tree").mapInPandas(search, "u long, v long")


def grouped(spark: SparkSession, docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest id that links reach) of every row of ``docs`` (``doc_id``, ``text``)."""
    prints = _kept(spark, fingerprints(docs, width), "simhash-prints")
    nodes = _kept(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(spark, links(spark, nodes.select("fp"), radius))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(least, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


@query("op11_simhash_bk")
def op11_simhash_bk(spark, sf_dir):
    out = grouped(spark, only(documents(spark, sf_dir)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
