"""Byte-level BPE over a given rank file, merged with a segment tree over byte positions.

Every match of the split pattern is a piece. A piece starts as single bytes; leaf ``i`` of its tree holds the rank of
the token that starts at byte ``i`` joined with its right neighbour, and every inner node the smaller rank of its two
children. The root names the next merge, a walk that prefers the left child finds its leftmost place, and a merge
changes three leaves: the merged pair, its left neighbour and the byte position that dies. Each change climbs to the
root in logarithmic time, and stops where a node keeps its minimum. The trees of many pieces of similar length are rows of
one numpy matrix and step together; a very long piece has a tree of its own, which steps without waiting for others. A
worker merges equal pieces once and remembers their ids from slice to slice, up to a bound.

Work is local to a row, so it needs no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm.common import Numbering, col, documents, free_name, only, query

NONE = np.int32(2**31 - 1)
SHIFT = 21
#: Characters of text whose pieces are held at once, and tree leaves that step together.
SLICE_CHARS = 4_000_000
BLOCK_LEAVES = 1 << 18
#: Bytes from which a piece is merged alone.
LONG_PIECE = 2048
#: Documents whose ids and bytes a task holds before it gives them out.
SLICE_DOCS = 2000
#: Bytes of pieces after which a worker forgets all; those of the slice at hand come on top.
KNOWN_BYTES = 2_000_000


def read_ranks(path: str) -> bytes:
    """The rank file as it is; the driver reads it, tasks get it as one broadcast (a fixed vocabulary, under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Token bytes by id, and the id that each joinable pair of ids makes."""

    def __init__(self, content: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.bytes_of = [b""] * (max(self.ids.values()) + 1)
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        self.split = regex.compile(pattern).findall
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"rank file has no token for bytes {missing[:5]}")
        if len(self.bytes_of) > 1 << SHIFT:
            raise ValueError(f"token ids above {1 << SHIFT} are not supported")
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << SHIFT | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.pair_made = np.append(np.array(made, np.int32)[order], NONE)
        self._pairs: dict[int, int] | None = None
        self.forget()

    def forget(self) -> None:
        """Start without known pieces."""
        self.known, self.known_bytes = Numbering(), 0
        self.flat = np.empty(0, np.int32)
        self.starts = self.lengths = np.empty(0, np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Append the ids of new pieces, which are numbered already."""
        flat, starts, lengths = self.encode_pieces(pieces)
        self.starts = np.append(self.starts, starts + self.flat.size)
        self.flat, self.lengths = np.append(self.flat, flat), np.append(self.lengths, lengths)
        self.known_bytes += sum(map(len, pieces))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where a pair makes no token."""
        key = left.astype(np.int64) << SHIFT | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], NONE)

    def merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of 2 to ``width`` bytes, ``width`` a power of two: all in a row, and how many each piece has."""
        m = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, m)
        inside = np.arange(width) < length[:, None]
        token = np.zeros((m, width + 1), np.int32)
        token[:, :width][inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))
        alive = inside
        tree = np.full((m, 2 * width), NONE, np.int32)
        pair = inside[:, 1:]
        tree[:, width : 2 * width - 1][pair] = self.joined(token[:, : width - 1][pair], token[:, 1:width][pair])
        level = width
        while level > 1:
            level //= 2
            below = tree[:, 2 * level : 4 * level]
            tree[:, level : 2 * level] = np.minimum(below[:, ::2], below[:, 1::2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            best = tree[rows, 1]
            node = np.ones(rows.size, np.int64)
            for _ in range(width.bit_length() - 1):
                node *= 2
                node += tree[rows, node] != best
            here = node - width
            dies = after[rows, here]
            then = after[rows, dies]
            left = before[rows, here]
            has_next, has_left = then < length[rows], left >= 0
            token[rows, here] = best
            alive[rows, dies] = False
            after[rows, here] = then
            r, t, h = rows[has_next], then[has_next], here[has_next]
            before[r, t] = h
            tree[rows, node] = NONE
            tree[r, node[has_next]] = self.joined(best[has_next], token[r, t])
            self._climb(tree, rows, node)
            tree[rows, dies + width] = NONE
            self._climb(tree, rows, dies + width)
            r, p = rows[has_left], left[has_left]
            tree[r, p + width] = self.joined(token[r, p], best[has_left])
            self._climb(tree, r, p + width)
            rows = rows[tree[rows, 1] != NONE]
        return token[:, :width][alive], alive.sum(axis=1)

    def merge_alone(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same tree, held in lists."""
        n, width = len(piece), 1 << (len(piece) - 1).bit_length()
        none = int(NONE)
        token = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = np.full(width, NONE, np.int32)
        ids = np.array(token, np.int32)
        leaves[: n - 1] = self.joined(ids[:-1], ids[1:])
        levels = [leaves]
        while levels[-1].size > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none] + [x for level in reversed(levels) for x in level.tolist()]
        alive = bytearray(b"\1") * n
        made = self.pairs_made().get

        def put(place: int, rank: int) -> None:
            node = place + width
            tree[node] = rank
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                least = rank if rank < other else other
                if tree[node] == least:
                    return
                tree[node] = rank = least

        while (best := tree[1]) != none:
            node = 1
            while node < width:
                node *= 2
                if tree[node] != best:
                    node += 1
            here = node - width
            dies = after[here]
            then = after[here] = after[dies]
            token[here], alive[dies] = best, 0
            put(dies, none)
            if then < n:
                before[then] = here
                put(here, made(best << SHIFT | token[then], none))
            else:
                put(here, none)
            if (left := before[here]) >= 0:
                put(left, made(token[left] << SHIFT | best, none))
        return np.array(token, np.int32)[np.frombuffer(alive, np.uint8) == 1]

    def pairs_made(self) -> dict[int, int]:
        """The joinable pairs as a dictionary; made when the first long piece comes."""
        if self._pairs is None:
            self._pairs = dict(zip(self.pair_keys[:-1].tolist(), self.pair_made[:-1].tolist()))
        return self._pairs

    @staticmethod
    def _climb(tree: np.ndarray, rows: np.ndarray, node: np.ndarray) -> None:
        node = node >> 1
        while node.size and node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, and where the ids of each piece start and how many they are."""
        whole = np.fromiter((self.ids.get(p, -1) for p in pieces), np.int64, len(pieces))
        done = np.flatnonzero(whole >= 0)
        flat, places, counts = [whole[done].astype(np.int32)], [done], [np.ones(done.size, np.int64)]
        by_width: dict[int, list[int]] = {}
        for i in np.flatnonzero(whole < 0).tolist():
            if len(pieces[i]) >= LONG_PIECE:
                ids = self.merge_alone(pieces[i])
                flat.append(ids)
                places.append(np.array([i]))
                counts.append(np.array([ids.size]))
                continue
            by_width.setdefault((len(pieces[i]) - 1).bit_length(), []).append(i)
        for bits, members in by_width.items():
            step = max(1, BLOCK_LEAVES >> bits)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                ids, n = self.merge([pieces[i] for i in some], 1 << bits)
                flat.append(ids)
                places.append(np.array(some))
                counts.append(n)
        place, count = np.concatenate(places), np.concatenate(counts)
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[place] = np.cumsum(count) - count
        lengths[place] = count
        return np.concatenate(flat), starts, lengths

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; a null text is an empty one."""
        a = 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and (b == a or chars + len(texts[b] or "") <= SLICE_CHARS):
                chars += len(texts[b] or "")
                b += 1
            if self.known_bytes > KNOWN_BYTES:
                self.forget()
            old = len(self.known)
            found = [np.fromiter(map(self.known.__getitem__, self.split(t or "")), np.int32) for t in texts[a:b]]
            if len(self.known) > old:
                self.learn([p.encode() for p in islice(self.known, old, None)])
            flat, starts, lengths = self.flat, self.starts, self.lengths
            for one in found:
                n = lengths[one]
                first = np.repeat(starts[one] - (np.cumsum(n) - n), n)
                yield flat[first + np.arange(first.size)]
            a = b

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_BUILT: dict[tuple, Vocabulary] = {}


def _vocabulary(content: bytes, pattern: str) -> Vocabulary:
    """One per worker process and rank file."""
    key = (hash(content), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Vocabulary(content, pattern)
    return _BUILT[key]


def _slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for a in range(0, len(texts), SLICE_DOCS):
            yield texts.iloc[a : a + SLICE_DOCS]


class Codec:
    """Column functions for one rank file and split pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        shipped = spark.sparkContext.broadcast(read_ranks(path))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = _vocabulary(shipped.value, pattern)
            for texts in _slices(batches):
                yield pd.Series(list(known.encode(texts.tolist())), dtype=object)

        @F.pandas_udf(T.BinaryType())
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = _vocabulary(shipped.value, pattern)
            for rows in batches:
                yield pd.Series([known.decode(np.asarray([] if r is None else r, np.int32)) for r in rows], dtype=object)

        @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known = _vocabulary(shipped.value, pattern)
            for texts in _slices(batches):
                ids = list(known.encode(texts.tolist()))
                yield pd.DataFrame({"ids": ids, "decoded": [known.decode(x) for x in ids]}, dtype=object)

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """Token ids of a text; none for a null text."""
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """Bytes of token ids; none for null."""
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        """Struct of the ids and of the bytes they decode to, from one pass."""
        return self._both(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and a struct column ``bpe`` (``ids``, ``decoded``) under the first free name.

    Null and empty texts have no ids. Repeated rows are encoded each.
    """
    return docs.withColumn(free_name(docs.columns, "bpe"), codec.round_trip(col(text)))


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of the decoded bytes."""
    out = encode_documents(only(docs), codec)
    return out.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )


def public_codec(spark: SparkSession) -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir), public_codec(spark))
