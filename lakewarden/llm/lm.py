"""Language-model scores from an Elias-Fano n-gram trie (order 2).

1. *Words.* Tasks count hashed tokens of the training documents; sorted (hash, count) blocks go to shards of the hash
   range, which write the sorted hashes and their running counts. A word's id is its rank.
2. *Ids.* Documents become rows of word ids, once, in a table; the base score falls off on the way.
3. *Pairs.* Tasks count (context, word) pairs of training documents. A pair's shard follows from the running counts of
   its context and, inside a hot context, of its word: shards are ranges of pairs with about the same number of tokens,
   and no context is too large for one. A shard keeps all its pairs, takes ``DISCOUNT`` off each and
   writes one trie: Elias-Fano pointers from contexts to their successors, Elias-Fano successors relative to the
   context, 16-bit logarithms of the discounted probabilities, and what a context's kept pairs add up to.
4. *Scores.* Tasks map the shard files into memory and search successors. What a context has left goes to the smoothed
   unigram, so that ``P(w | c) = q(c, w) + (1 - sum of q(c, .)) * P1(w)`` adds up to 1.

Files lie in the shared folder and are renamed into place, so a task that runs again replaces its own file. Folders that
can't be mapped are read instead; then a worker holds the model in memory.
"""

from __future__ import annotations

import io
import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import eliasfano
from lakewarden.llm.common import WordHashes, documents, local_path, only, query
from lakewarden.session import new_scratch

HELD_OUT = 10
ADD = 0.1
DISCOUNT = 0.75
#: Shards of the hash range, and training tokens of one shard of pairs.
WORD_SHARDS = 64
SHARD_TOKENS = 4_000_000
#: Contains a space, so no word has its hash.
END = xxhash.xxh64_intdigest(b" end ")
UNKNOWN = np.uint32(0xFFFFFFFF)
#: Logarithms of probabilities are kept as steps from 0 down to this.
LOWEST_LOG10 = -12.0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def _hashed(texts, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, each text closed by the end token, and the number per text."""
    parts, sizes = [], []
    end = np.array([END], np.uint64)
    for text in texts:
        words = (text or "").encode().lower().split()
        parts += [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), end]
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def _write(folder: str, name: str, parts: dict[str, np.ndarray]) -> None:
    """All arrays as one file, 64-byte aligned behind a JSON head; written aside and renamed."""
    head, at, body = {}, 0, io.BytesIO()
    for key, a in parts.items():
        a = np.ascontiguousarray(a)
        body.write(b"\0" * (-at % 64))
        at += -at % 64
        head[key] = [a.dtype.str, a.size, at]
        body.write(a.tobytes())
        at += a.nbytes
    first = json.dumps(head).encode()
    first += b" " * (-(len(first) + 8) % 64)
    content = len(first).to_bytes(8, "little") + first + body.getvalue()
    path, aside = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
    if (local := local_path(folder)) is not None:
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/.{name}.{uuid.uuid4().hex}", "wb") as f:
            f.write(content)
        os.replace(f.name, f"{local}/{name}")
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(aside)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(content)
    store.move(inner, fs.FileSystem.from_uri(path)[1])


@lru_cache(maxsize=4096)
def _read(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """Arrays of a file, mapped where the folder is local; None if the shard has no file."""
    if (local := local_path(folder)) is not None:
        path = f"{local}/{name}"
        if not os.path.exists(path):
            return None
        raw = np.memmap(path, np.uint8, "r")
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(f"{folder}/{name}")
        if store.get_file_info(inner).type == fs.FileType.NotFound:
            return None
        with store.open_input_file(inner) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[8 + size + at : 8 + size + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in head.items()}


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if starts.size else counts


class _Sums:
    """Sorted keys and counts that blocks are added to; merged whenever the new ones outgrow the old."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.new, self.waiting = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.waiting += keys.size
        if self.waiting > self.keys.size + 100_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            keys = np.concatenate([self.keys, *[k for k, _ in self.new]])
            counts = np.concatenate([self.counts, *[c for _, c in self.new]])
            self.keys, self.counts = _summed(keys, counts)
            self.new, self.waiting = [], 0
        return self.keys, self.counts


def count_words(spark: SparkSession, docs: DataFrame, folder: str) -> list[tuple[int, int, int]]:
    """Write the word shards; returns (shard, words, tokens) of each."""
    step = np.uint64(64 - WORD_SHARDS.bit_length() + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sums = WordHashes(), _Sums()
        for batch in batches:
            train = [t for i, t in zip(batch["doc_id"], batch["text"]) if not held_out(None if pd.isna(i) else int(i))]
            sums.add(*np.unique(_hashed(train, hashes)[0], return_counts=True))
        keys, counts = sums.merge()
        edges = np.searchsorted(keys >> step, np.arange(WORD_SHARDS + 1))
        for s in range(WORD_SHARDS):
            a, b = edges[s], edges[s + 1]
            if a < b:
                yield pd.DataFrame({"shard": [s], "keys": [keys[a:b].tobytes()], "counts": [counts[a:b].astype("<i8").tobytes()]})

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Sums] = {}
        for batch in batches:
            for s, keys, counts in zip(batch["shard"], batch["keys"], batch["counts"]):
                held.setdefault(s, _Sums()).add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8"))
        for s, sums in held.items():
            keys, counts = sums.merge()
            upto = np.concatenate([[0], np.cumsum(counts)])
            _write(folder, f"words-{s:05d}", {"keys": keys, "upto": upto})
            yield pd.DataFrame({"shard": [s], "words": [keys.size], "tokens": [int(upto[-1])]})

    blocks = docs.mapInPandas(count, "shard int, keys binary, counts binary").repartition("shard")
    done = blocks.mapInPandas(store, "shard int, words long, tokens long").collect()  # one row per shard
    return sorted((r.shard, r.words, r.tokens) for r in done)


class Words:
    """Ids, counts and running counts of words, from the word shards."""

    def __init__(self, folder: str, shards: list[tuple[int, int, int]]):
        self.folder = folder
        self.words = np.zeros(WORD_SHARDS + 1, np.int64)
        self.tokens = np.zeros(WORD_SHARDS + 1, np.int64)
        for s, words, tokens in shards:
            self.words[s + 1], self.tokens[s + 1] = words, tokens
        self.words, self.tokens = np.cumsum(self.words), np.cumsum(self.tokens)
        self.V, self.N = int(self.words[-1]), int(self.tokens[-1])
        if self.V >= int(UNKNOWN):
            raise ValueError("more distinct words than 32-bit ids")

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes; ``UNKNOWN`` where there is none."""
        out = np.full(hashes.size, UNKNOWN, np.uint32)
        step = np.uint64(64 - WORD_SHARDS.bit_length() + 1)
        edges = np.searchsorted(hashes >> step, np.arange(WORD_SHARDS + 1))
        for s in range(WORD_SHARDS):
            a, b = edges[s], edges[s + 1]
            if a < b and (parts := _read(self.folder, f"words-{s:05d}")) is not None:
                keys = parts["keys"]
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), keys.size - 1)
                out[a:b] = np.where(keys[at] == hashes[a:b], at + self.words[s], UNKNOWN)
        return out

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running count before, and own count, of ascending known ids."""
        before, own = np.zeros(ids.size, np.int64), np.zeros(ids.size, np.int64)
        edges = np.searchsorted(ids, self.words)
        for s in range(WORD_SHARDS):
            a, b = edges[s], edges[s + 1]
            if a < b:
                upto, at = _read(self.folder, f"words-{s:05d}")["upto"], ids[a:b].astype(np.int64) - self.words[s]
                before[a:b] = upto[at] + self.tokens[s]
                own[a:b] = upto[at + 1] - upto[at]
        return before, own

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.N + ADD * (self.V + 1))


def as_ids(spark: SparkSession, docs: DataFrame, words: Words) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``base_score`` and ``ids`` of every document, as a written table."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            tokens, sizes = _hashed(batch["text"], hashes)
            distinct, back = np.unique(tokens, return_inverse=True)
            ids = words.ids(distinct)
            known = ids != UNKNOWN
            counts = np.zeros(ids.size, np.int64)
            counts[known] = words.spans(ids[known])[1]
            logs = np.log10(words.unigram(counts))
            starts = np.cumsum(sizes) - sizes
            own = ids[back]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": [held_out(None if pd.isna(i) else int(i)) for i in batch["doc_id"]],
                    "n_tokens": sizes,
                    "n_known": np.add.reduceat(known[back].astype(np.int64), starts) if sizes.size else sizes,
                    "base_score": np.add.reduceat(logs[back], starts) if sizes.size else sizes.astype(float),
                    "ids": [own[a : a + n].tobytes() for a, n in zip(starts, sizes)],
                }
            )

    path = new_scratch(spark, "word-ids")
    docs.mapInPandas(convert, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, ids binary").write.parquet(path)
    return spark.read.parquet(path)


class Pairs:
    """Shards of pairs and their files."""

    def __init__(self, folder: str, words: Words, end: int):
        self.folder, self.words, self.end = folder, words, end
        self.shards = max(1, -(-words.N // SHARD_TOKENS))

    def place(self, before: np.ndarray, own: np.ndarray, word_before: np.ndarray) -> np.ndarray:
        """Shard of pairs: the context's running count, and inside it the share of words before the word. Monotone."""
        inside = before + (own * (word_before / max(1, self.words.N))).astype(np.int64)
        return inside * self.shards // max(1, self.words.N)

    def of_texts(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and words of all tokens; the end of a text comes before its first word."""
        rows = [np.frombuffer(x, "<u4") for x in ids]
        word = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        sizes = np.array([r.size for r in rows], np.int64)
        context[np.cumsum(sizes) - sizes] = self.end
        return context, word

    def build(self, table: DataFrame) -> list[tuple[int, int]]:
        """Write the trie shards; returns (shard, pairs kept) of each."""
        words = self.words

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                context, word = self.of_texts(batch["ids"])
                keys, counts = np.unique(context.astype(np.uint64) << np.uint64(32) | word, return_counts=True)
                context, word = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                shard = self.place(*self._context_spans(context), self._word_before(word))
                edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if shard.size else np.empty(0, np.int64)
                for a, b in zip(edges, [*edges[1:], shard.size]):
                    first = np.flatnonzero(np.append(True, context[a + 1 : b] != context[a : b - 1]))
                    yield pd.DataFrame(
                        {
                            "shard": [int(shard[a])],
                            "contexts": [context[a:b][first].tobytes()],
                            "sizes": [np.diff(np.append(first, b - a)).astype("<u4").tobytes()],
                            "words": [word[a:b].tobytes()],
                            "counts": [counts[a:b].astype("<u4").tobytes()],
                        }
                    )

        def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, _Sums] = {}
            for batch in batches:
                for row in batch.itertuples():
                    context = np.repeat(np.frombuffer(row.contexts, "<u4"), np.frombuffer(row.sizes, "<u4"))
                    keys = context.astype(np.uint64) << np.uint64(32) | np.frombuffer(row.words, "<u4")
                    held.setdefault(row.shard, _Sums()).add(keys, np.frombuffer(row.counts, "<u4").astype(np.int64))
            for s, sums in held.items():
                keys, counts = sums.merge()
                _write(self.folder, f"pairs-{s:07d}", self._trie(keys, counts))
                yield pd.DataFrame({"shard": [s], "kept": [keys.size]})

        del words
        blocks = table.filter("not held_out").select("ids").mapInPandas(
            count, "shard int, contexts binary, sizes binary, words binary, counts binary"
        )
        done = blocks.repartition("shard").mapInPandas(store, "shard int, kept long").collect()  # one row per shard
        return sorted((r.shard, r.kept) for r in done)

    def _context_spans(self, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(ascending, return_inverse=True)
        before, own = self.words.spans(distinct)
        return before[back], own[back]

    def _word_before(self, word: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(word, return_inverse=True)
        return self.words.spans(distinct)[0][back]

    def _trie(self, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Levels of one shard: contexts ``low`` to ``high``, pointers, successors, probabilities and kept sums."""
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low = int(context[0]) if context.size else 0
        span = int(context[-1]) - low + 1 if context.size else 0
        own = self._context_spans(context.astype(np.uint32))[1] if context.size else counts
        log = np.log10((counts - DISCOUNT) / np.maximum(own, 1)) if context.size else np.empty(0)
        code = np.round(np.clip(log / LOWEST_LOG10, 0, 1) * 65535).astype("<u2")
        kept = np.bincount(context - low, weights=probability(code), minlength=span) if context.size else np.empty(0)
        pointers = np.searchsorted(context - low, np.arange(span + 1))
        relative = (context - low) * self.words.V + word
        levels = {"low": np.array([low, span], np.int64), "code": code, "kept": kept.astype("<f4")}
        levels |= {f"pointers.{k}": v for k, v in eliasfano.encode(pointers, keys.size + 1).items()}
        levels |= {f"successors.{k}": v for k, v in eliasfano.encode(relative, max(1, span * self.words.V)).items()}
        return levels

    def probabilities(self, context: np.ndarray, word: np.ndarray, own: np.ndarray, before: np.ndarray, word_before: np.ndarray):
        """``q`` of known pairs in ascending order."""
        q = np.zeros(context.size)
        shard = self.place(before, own, word_before)
        edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if shard.size else np.empty(0, np.int64)
        for a, b in zip(edges, [*edges[1:], shard.size]):
            if (trie := _trie_of(self.folder, int(shard[a]))) is not None:
                q[a:b] = trie.find(context[a:b].astype(np.int64), word[a:b].astype(np.int64), self.words.V)
        return q

    def kept(self, context: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What the kept pairs of ascending contexts add up to, over all shards that a context reaches into."""
        zero, full = np.zeros(1), np.full(1, float(self.words.N))
        out = np.zeros(context.size)
        first = self.place(before, own, zero)
        last = np.minimum(self.place(before, own, full), self.shards - 1)
        for s in range(int(first.min()), int(last.max()) + 1) if context.size else ():
            mine = np.flatnonzero((first <= s) & (s <= last))
            if mine.size and (trie := _trie_of(self.folder, s)) is not None:
                out[mine] += trie.kept_of(context[mine].astype(np.int64))
        return out


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code.astype(np.float64) / 65535 * LOWEST_LOG10)


class Trie:
    """One shard, read through its maps."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.span = (int(x) for x in parts["low"])
        self.code, self.kept = parts["code"], parts["kept"]
        cut = lambda level: {k.split(".")[1]: v for k, v in parts.items() if k.startswith(level + ".")}
        self.pointers, self.successors = eliasfano.Sequence(cut("pointers")), eliasfano.Sequence(cut("successors"))

    def kept_of(self, context: np.ndarray) -> np.ndarray:
        at = context - self.low
        here = (at >= 0) & (at < self.span)
        out = np.zeros(context.size)
        out[here] = self.kept[at[here]]
        return out

    def find(self, context: np.ndarray, word: np.ndarray, V: int) -> np.ndarray:
        out, at = np.zeros(context.size), context - self.low
        here = np.flatnonzero((at >= 0) & (at < self.span))
        if not here.size:
            return out
        distinct, back = np.unique(at[here], return_inverse=True)
        start, end = self.pointers.get(distinct)[back], self.pointers.get(distinct + 1)[back]
        some = start < end
        here, start, end = here[some], start[some], end[some]
        value = at[here] * V + word[here]
        place = self.successors.successor(value, start, end)
        inside = place < end
        here, place, value = here[inside], place[inside], value[inside]
        hit = self.successors.get(place) == value
        out[here[hit]] = probability(self.code[place[hit]])
        return out


@lru_cache(maxsize=4096)
def _trie_of(folder: str, shard: int) -> Trie | None:
    parts = _read(folder, f"pairs-{shard:07d}")
    return None if parts is None else Trie(parts)


def scored(table: DataFrame, pairs: Pairs) -> DataFrame:
    """Rows of ``as_ids`` with ``score``, the model's log10 probability of the whole text."""
    words = pairs.words

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            context, word = pairs.of_texts(batch["ids"])
            keys, back = np.unique(context.astype(np.uint64) << np.uint64(32) | word, return_inverse=True)
            c, w = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            ids, of_word = np.unique(w, return_inverse=True)
            known = ids != UNKNOWN
            w_before, w_own = np.zeros(ids.size, np.int64), np.zeros(ids.size, np.int64)
            w_before[known], w_own[known] = words.spans(ids[known])
            contexts, of_context = np.unique(c, return_inverse=True)
            in_c = contexts != UNKNOWN
            c_before, c_own, left = np.zeros(contexts.size, np.int64), np.zeros(contexts.size, np.int64), np.ones(contexts.size)
            c_before[in_c], c_own[in_c] = words.spans(contexts[in_c])
            left[in_c] -= pairs.kept(contexts[in_c], c_before[in_c], c_own[in_c])
            q = np.zeros(keys.size)
            both = np.flatnonzero((c != UNKNOWN) & (w != UNKNOWN))
            q[both] = pairs.probabilities(
                c[both], w[both], c_own[of_context[both]], c_before[of_context[both]], w_before[of_word[both]]
            )
            p = q + np.maximum(left[of_context], 1e-12) * words.unigram(w_own)[of_word]
            sizes = batch["n_tokens"].to_numpy()
            batch["score"] = np.add.reduceat(np.log10(p)[back], np.cumsum(sizes) - sizes) if sizes.size else sizes.astype(float)
            yield batch.drop(columns="ids")

    return table.mapInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_model(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row of
    ``docs`` (``doc_id``, ``text``).

    Null and empty texts are the end token alone. Rows without an id are held out. Repeated rows are learnt and scored
    each. Without a training document every token is unknown, and both scores are 0 for each.
    """
    folder = new_scratch(spark, "ngram-trie")
    words = Words(folder, count_words(spark, docs, folder))
    table = as_ids(spark, docs, words)
    end = words.ids(np.array([END], np.uint64))[0]
    pairs = Pairs(folder, words, int(end))
    if words.N:
        pairs.build(table)
    return scored(table, pairs).withColumn("train_tokens", F.lit(words.N).cast("long"))


@query("op7_trie_scores")
def op7_trie_scores(spark, sf_dir):
    out = language_model(spark, only(documents(spark, sf_dir)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


assert math.log2(WORD_SHARDS) % 1 == 0
