"""Prefix trie of conversations, built from Z-fast tries.

1. *Paths.* Turn texts become digests and byte counts at once. Conversations of one group of five meet in one sorted
   partition, where each is rebuilt, turn by turn, and every prefix of it gets a hash that follows from the one before.
2. *Z-fast tries.* Tasks build tries of bounded slices of conversations. A compacted node stands for all depths between
   its parent's and its own; a table finds it by the prefix at its handle, the depth in that range that the highest power
   of two divides. Conversations come in batches: each is located by fat binary search, which asks for the handles
   that the path would have and halves the depths left with each answer, and is then inserted below its exit node.
3. *Edges.* Compacted nodes are expanded to one row per depth, with the smallest member. Nodes of all tries meet by
   depth and hash, one row per slice and node, however many conversations pass through it.
4. *Owners.* The smallest member of a node is its owner; a conversation owns the nodes of its path from some depth on.
   Turns that a member doesn't own are those that a shared prefix saves, and children and leaves count by their owners,
   so all figures of subtrees are sums over single conversations. Nothing walks from node to node.
5. *Ends.* Ids that end at a node are joined in blocks of an id range, and the digest of a node takes its blocks in
   order, one at a time.

Null roles and texts are empty. Turns are taken by number, null first; equal numbers by a digest of role and text, so that
repeated rows are a turn each. Rows without a conversation id belong to no conversation and are left out. A base that isn't
there lends no turns; a conversation without turns of its own left and without a base's ends at the root. An empty table
gives no rows, not even a root. Very long texts only ever are one row; a very long conversation is one path in memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import col, query, visible_to_workers
from lakewarden.session import new_scratch

GROUP = 5
HEADS = 9
#: Bytes of a prefix hash.
WIDE = 16
#: Turns of a slice, and conversations of a batch.
SLICE_TURNS, BATCH = 400_000, 1024
#: Ids of an end block come from a range of this size.
END_RANGE = 4096


def fattest(low: int, high: int) -> int:
    """The number in ``low`` + 1 to ``high`` that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie of paths. A path is a blob of prefix hashes: that of depth ``d`` ends at byte ``WIDE * d``."""

    def __init__(self):
        self.start, self.extent, self.blob, self.parent, self.least, self.has_child = [-1], [0], [b""], [-1], [None], [False]
        self.handles: dict[tuple[int, bytes], int] = {}
        self.edges: dict[tuple[int, bytes], int] = {}

    @staticmethod
    def _at(blob: bytes, depth: int) -> bytes:
        return blob[WIDE * (depth - 1) : WIDE * depth]

    def _hang(self, node: int) -> None:
        """Enter a node under its handle and the first depth of its edge."""
        blob, start, extent = self.blob[node], self.start[node], self.extent[node]
        handle = fattest(start, extent)
        self.handles[handle, self._at(blob, handle)] = node
        self.edges[start + 1, self._at(blob, start + 1)] = node

    def _new(self, start: int, extent: int, blob: bytes, parent: int) -> int:
        self.start.append(start)
        self.extent.append(extent)
        self.blob.append(blob)
        self.parent.append(parent)
        self.least.append(None)
        self.has_child.append(False)
        self.has_child[parent] = True
        return len(self.start) - 1

    def exit_node(self, blob: bytes, node: int = 0) -> int:
        """The deepest node whose edge a path enters; ``node`` is one that lies on it whole."""
        low, high = self.extent[node], len(blob) // WIDE
        while low < high:
            middle = fattest(low, high)
            hit = self.handles.get((middle, self._at(blob, middle)))
            if hit is None:
                high = middle - 1
                continue
            end = self.extent[hit]
            if end > len(blob) // WIDE or self._at(blob, end) != self._at(self.blob[hit], end):
                return hit
            node, low = hit, end
        if low == len(blob) // WIDE:
            return node
        return self.edges.get((low + 1, self._at(blob, low + 1)), node)

    def _common(self, blob: bytes, node: int) -> int:
        """Depth down to which a path that enters the edge of a node follows it."""
        low, high = max(0, self.start[node]), min(self.extent[node], len(blob) // WIDE)
        other = self.blob[node]
        while low < high:
            middle = (low + high + 1) // 2
            if self._at(blob, middle) == self._at(other, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def _insert(self, blob: bytes, conv: int, above: int) -> None:
        node = self.exit_node(blob, above)
        depth = self._common(blob, node)
        if depth < self.extent[node]:  # cut the edge: a new node takes its upper part
            start = self.start[node]
            del self.handles[(handle := fattest(start, self.extent[node])), self._at(self.blob[node], handle)]
            middle = self._new(start, depth, blob, self.parent[node])
            self.has_child[middle] = True
            self.start[node], self.parent[node] = depth, middle
            self._hang(middle)
            self._hang(node)
            node = middle
        if depth < len(blob) // WIDE:
            node = self._new(depth, len(blob) // WIDE, blob, node)
            self._hang(node)
        if self.least[node] is None or conv < self.least[node]:
            self.least[node] = conv

    def insert(self, batch: list[tuple[int, bytes]]) -> None:
        """Locate all paths of a batch, then insert them exit by exit, each search going on above its exit."""
        located: dict[int, list[tuple[int, bytes]]] = {}
        for conv, blob in batch:
            exit_ = self.exit_node(blob)
            located.setdefault(exit_ if exit_ == 0 else self.parent[exit_], []).append((conv, blob))
        for above, paths in located.items():
            for conv, blob in paths:
                self._insert(blob, conv, above)

    def expanded(self) -> pd.DataFrame:
        """One row per depth of every edge: ``depth``, ``h1``, ``h2``, smallest member, and whether any node follows."""
        order = sorted(range(1, len(self.start)), key=self.extent.__getitem__, reverse=True)
        for node in order:
            up = self.parent[node]
            if self.least[up] is None or self.least[node] < self.least[up]:
                self.least[up] = self.least[node]
        depths, blobs, least, followed = [np.zeros(1, np.int64)], [bytes(WIDE)], [self.least[:1]], [np.array(self.has_child[:1])]
        for node in order:
            start, extent = self.start[node], self.extent[node]
            depths.append(np.arange(start + 1, extent + 1))
            blobs.append(self.blob[node][WIDE * start : WIDE * extent])
            least.append([self.least[node]] * (extent - start))
            inner = np.ones(extent - start, bool)
            inner[-1] = self.has_child[node]
            followed.append(inner)
        h = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
        return pd.DataFrame(
            {"depth": np.concatenate(depths), "h1": h[:, 0], "h2": h[:, 1], "least": np.concatenate(least).astype(np.int64), "followed": np.concatenate(followed)}
        )


def head_turns(conv: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % HEADS


def base_of(conv: int) -> int:
    """``conv - conv % GROUP`` with the remainder's sign that of the id."""
    return conv - (conv % GROUP if conv >= 0 else -(-conv % GROUP))


def _path(turns: list[tuple[bytes, int]]) -> tuple[bytes, list[int]]:
    hashes, upto, last = [], [0], b""
    for digest, size in turns:
        last = hashlib.sha256(last + digest).digest()[:WIDE]
        hashes.append(last)
        upto.append(upto[-1] + size)
    return b"".join(hashes), upto


def paths(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``conv_id``, ``blob`` (prefix hashes) and ``upto`` (bytes of the first turns) of every rebuilt conversation, as a
    written table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    rows = turns.filter("conv_id is not null").select(
        base.alias("base"), "conv_id", "turn", F.unhex(F.sha2(named.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("size")
    )
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, own, base, head = None, [], None, []

        def done():
            nonlocal base, head
            if conv == (of := base_of(conv)):
                base, head = conv, own[: HEADS - 1]
                return (conv, *_path(own))
            h = head_turns(conv)
            return (conv, *_path((head[:h] if base == of else []) + own[h:]))

        for batch in batches:
            out = []
            for c, digest, size in zip(batch["conv_id"].tolist(), batch["digest"], batch["size"].tolist()):
                if c != conv:
                    if conv is not None:
                        out.append(done())
                    conv, own = c, []
                own.append((digest, size))
            yield pd.DataFrame(out, columns=["conv_id", "blob", "upto"])
        if conv is not None:
            yield pd.DataFrame([done()], columns=["conv_id", "blob", "upto"])

    path = new_scratch(spark, "conversation-paths")
    rows.select("conv_id", "digest", "size").mapInPandas(rebuild, "conv_id long, blob binary, upto array<long>").write.parquet(path)
    return spark.read.parquet(path)


def trie_nodes(spark: SparkSession, table: DataFrame) -> DataFrame:
    """``depth``, ``h1``, ``h2``, ``least``, ``followed``: nodes of the tries of all slices, as a written table."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, waiting, held, some = ZFastTrie(), [], 0, False
        for batch in batches:
            for conv, blob in zip(batch["conv_id"].tolist(), batch["blob"]):
                some = True
                if not blob:  # ends at the root
                    trie.least[0] = conv if trie.least[0] is None else min(conv, trie.least[0])
                    continue
                waiting.append((conv, blob))
                held += len(blob) // WIDE
                if len(waiting) >= BATCH or held >= SLICE_TURNS:
                    trie.insert(waiting)
                    waiting = []
                if held >= SLICE_TURNS:
                    yield trie.expanded()
                    trie, held, some = ZFastTrie(), 0, False
        trie.insert(waiting)
        if some:
            yield trie.expanded()

    path = new_scratch(spark, "trie-nodes")
    table.select("conv_id", "blob").mapInPandas(build, "depth long, h1 long, h2 long, least long, followed boolean").write.parquet(path)
    return spark.read.parquet(path)


def owners(nodes: DataFrame) -> DataFrame:
    """``owner``, the depth its own nodes begin at (``owned``), and whether it owns a leaf."""
    whole = nodes.groupBy("depth", "h1", "h2").agg(F.min("least").alias("owner"), F.max("followed").alias("inner"))
    mine = nodes.select("depth", "h1", "h2", "least").join(whole, ["depth", "h1", "h2"]).filter("least = owner")
    return mine.groupBy("owner").agg(F.min("depth").alias("owned"), F.max(~F.col("inner")).alias("leaf"))


def member_rows(table: DataFrame, owned: DataFrame) -> DataFrame:
    """One row per conversation and depth of its path, with what it adds to the node there."""
    known = table.join(owned.withColumnRenamed("owner", "conv_id"), "conv_id", "left").select("conv_id", "blob", "upto", "owned", F.coalesce("leaf", F.lit(False)).alias("leaf"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for conv, blob, upto, owned, leaf in zip(batch["conv_id"], batch["blob"], batch["upto"], batch["owned"], batch["leaf"]):
                n = len(blob) // WIDE
                h = np.frombuffer(bytes(2 * WIDE) + blob, "<i8").reshape(-1, 2)
                upto, depth = np.asarray(upto, np.int64), np.arange(n + 1)
                first = n + 1 if pd.isna(owned) else int(owned)
                shared = upto[max(first - 1, 0)] - upto[np.maximum(depth, 1) - 1] if n else np.zeros(1, np.int64)
                yield pd.DataFrame(
                    {
                        "conv_id": conv, "depth": depth, "h1": h[1:, 0], "h2": h[1:, 1], "p1": h[:-1, 0], "p2": h[:-1, 1],
                        "child": ((first <= depth + 1) & (depth < n)).astype(np.int64), "leaf": int(leaf), "saved": np.maximum(shared, 0),
                    }
                )

    schema = "conv_id long, depth long, h1 long, h2 long, p1 long, p2 long, child long, leaf long, saved long"
    return known.mapInPandas(lambda batches: _together(spread(batches)), schema)


def _together(frames: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Small frames put together."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def end_digests(table: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, per ``depth``, ``h1``, ``h2`` of nodes where some do."""

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = np.frombuffer(b"".join((bytes(WIDE) + b)[-WIDE:] for b in batch["blob"]), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"conv_id": batch["conv_id"], "depth": batch["blob"].map(len) // WIDE, "h1": h[:, 0], "h2": h[:, 1]})

    ends = table.select("conv_id", "blob").mapInPandas(last, "conv_id long, depth long, h1 long, h2 long")
    block = F.floor(F.col("conv_id") / END_RANGE)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("depth", "h1", "h2", block.alias("block")).agg(ids.alias("ids"))  # END_RANGE ids at most
    ordered = blocks.repartition("depth", "h1", "h2").sortWithinPartitions("depth", "h1", "h2", "block")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, running, columns = None, None, ["depth", "h1", "h2", "ends_sha256"]
        for batch in batches:
            out = []
            for depth, h1, h2, ids in zip(*[batch[c].tolist() for c in ("depth", "h1", "h2", "ids")]):
                if (depth, h1, h2) == key:
                    running.update(b",")
                else:
                    if key is not None:
                        out.append((*key, running.hexdigest()))
                    key, running = (depth, h1, h2), hashlib.sha256()
                running.update(ids.encode())
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame([(*key, running.hexdigest())], columns=columns)

    return ordered.mapInPandas(digest, "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``)."""
    table = paths(spark, turns)
    owned = owners(trie_nodes(spark, table))
    path = new_scratch(spark, "trie-figures")
    (
        member_rows(table, owned)
        .groupBy("depth", "h1", "h2", "p1", "p2")
        .agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"),
            F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        )
        .write.parquet(path)
    )
    nodes = spark.read.parquet(path)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(above, ["depth", "p1", "p2"], "left")
        .join(end_digests(table), ["depth", "h1", "h2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible_to_workers(spark)
    return turns_only(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def turns_only(rows: DataFrame) -> DataFrame:
    """The four columns under their names, so that no other column can clash."""
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    return rows.select(*[col(c).cast(t).alias(c) for c, t in kinds.items()])


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""
_SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(concat(strlen(coalesce(role, '')), ':', role, text))) AS i FROM conversations WHERE conv_id IS NOT NULL),
  k AS (SELECT DISTINCT c FROM t),
  h AS (SELECT c, c - c % {GROUP} AS base, {_CRC} % {HEADS} AS h FROM k),
  r AS (SELECT h.c, t.i AS i, 0 AS part, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.i <= h.h
        UNION ALL SELECT h.c, t.i, 1, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.i > h.h),
  p AS (SELECT h.c, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.part, r.i) FILTER (r.i IS NOT NULL), []) AS seq
        FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
  m AS (SELECT c, d, len(seq) AS n, seq[1:d] AS prefix, CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS size
        FROM p, unnest(range(0, len(seq) + 1)) AS u(d)),
  g AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY prefix, d),
  s AS (SELECT up.prefix, count(*) FILTER (g.d = up.d + 1) AS n_children, sum((g.n_convs - 1) * g.size)::BIGINT AS saved_tokens,
        count(*) FILTER (NOT EXISTS (SELECT 1 FROM g AS x WHERE x.d = g.d + 1 AND x.prefix[1:g.d] = g.prefix)) AS n_leaves
        FROM g JOIN g AS up ON up.d <= g.d AND g.prefix[1:up.d] = up.prefix GROUP BY up.prefix)
SELECT g.conv_id, g.d::BIGINT AS depth, up.conv_id AS parent_conv_id, g.n_convs, s.n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM g JOIN s ON s.prefix = g.prefix LEFT JOIN g AS up ON up.d = g.d - 1 AND g.d > 0 AND g.prefix[1:g.d - 1] = up.prefix"""


@query("op12_zfast_trie", _SQL)
def op12_zfast_trie(spark, sf_dir):
    return prefix_trie(spark, conversations(spark, sf_dir))
