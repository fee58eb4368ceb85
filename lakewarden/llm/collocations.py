"""Phrase collocations by SETM relational mining.

1. *Occurrences.* Texts become pieces and words once. The relation of occurrences lies in blocks of one language: places
   ascend, a break between pieces takes a place of its own, and words are numbers of the block, the most frequent first.
   A language fills its block apart from others, so that fewer blocks tell of the same group.
2. *Group and count.* What a block holds is counted there first. Its distinct groups go to key ranges, where the counts
   of all blocks add up; every group of ``LEAST`` or more gets a number for good, which goes back to the blocks. Frequent
   groups have small numbers, and a block's pairs are numbered range by range in the order of their parts, so that they
   travel as small differences and their own numbers need not.
3. *Semi-join.* A block keeps the occurrences of groups that came back. Nothing is broadcast: a block hears of its own
   groups only, so the traffic follows the occurrences and not blocks times groups.
4. *Merge-join.* Phrases of ``k`` words at neighbouring places of a piece overlap in all but one word each, and make the
   phrases of ``k + 1`` words, which are persisted in the order of their places and counted in turn. All parts of a
   frequent phrase are frequent, so nothing is missed.
5. *Scores.* A phrase is known by the two phrases it overlaps from, so the counts of all its parts are joins between
   tables of frequent phrases, never of occurrences.

Arithmetic is on decimals where a product may pass 64 bits. Null texts have no words, a null language is ``und``. Repeated
rows count each, whatever their ids, and other columns are not looked at. A very long text makes one large block. Ties end
with the phrase itself, which is unique. Empty tables, and tables without a frequent phrase, give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import Numbering, col, documents, query
from lakewarden.session import new_scratch

LEAST, INSIDE, TOP, LONGEST = 30, 80, 2000, 4
SCALE = 2_000_000
#: Words of a block, blocks of words that a task holds at a time (a distinct word counts as ``DISTINCT`` words), and groups of
#: a key range.
BLOCK_WORDS, HELD_BLOCKS, DISTINCT, RANGE_GROUPS = 1_500_000, 4, 4, 500_000
#: Parts of a language whose best phrases are found apart.
TOP_PARTS = 64
NO_LANG = "und"

BREAK = b"\xff"  # no byte of UTF-8
_FOLDED = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\n\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" "
)
_SPACED = b" " + BREAK + b" "


def tokens(text: str | None) -> list[bytes]:
    """Words in order, with ``BREAK`` between pieces."""
    return (text or "").encode().translate(_FOLDED).replace(BREAK, _SPACED).split()


def _kept(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = new_scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes, as many a number as the largest takes; first bytes first, which lie close to each other and
    compress well."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, : blob[0]] = planes.T
    return numbers.view("<i8").reshape(-1)


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return packed(np.diff(ascending, prepend=0))


def _stepped(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob))


def paired(a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs in ascending order by their differences: those of the first numbers, and of the second where the first stay."""
    same = np.append(False, a[1:] == a[:-1])
    return _steps(a), packed(b - np.where(same, np.append(0, b[:-1]), 0))


def unpaired(first: bytes, second: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, steps = _stepped(first), unpacked(second)
    sums = np.cumsum(steps)
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if a.size else np.empty(0, np.int64)
    return a, sums - np.repeat(sums[start] - steps[start], np.diff(np.append(start, a.size)))


class Filling:
    """A block that is being filled: its words by number, and what it weighs in memory."""

    def __init__(self) -> None:
        self.vocabulary, self.parts, self.words, self.weight = Numbering({BREAK: 0}), [], 0, 0

    def add(self, words: list[bytes], end: np.ndarray) -> int:
        known = len(self.vocabulary)
        self.parts += [np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)), end]
        more = len(words) + 1 + (DISTINCT - 1) * (len(self.vocabulary) - known)
        self.words += len(words) + 1
        self.weight += more
        return more


BLOCK = "block long, lang string, n_all long, groups long, gaps binary, local binary"


def occurrences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Blocks of word occurrences of ``docs`` (``lang``, ``text``), as a written table.

    ``gaps`` and ``local`` are the places and word numbers of all occurrences, ``words`` and ``counts`` those of the numbers.
    """

    def block(number: int, lang: str, mine: Filling) -> pd.DataFrame:
        local = np.concatenate(mine.parts)
        places = np.flatnonzero(local)
        local = local[places] - 1  # number 0 is the break
        words = list(mine.vocabulary)[1:]
        counts = np.bincount(local, minlength=len(words))
        order = np.argsort(-counts, kind="stable")
        local, words = np.argsort(order)[local], [words[i] for i in order]
        row = (number, lang, int(places.size), len(words), _steps(places), packed(local), packed(counts[order]), zlib.compress(b"\n".join(words), 1))
        return pd.DataFrame([row], columns=["block", "lang", "n_all", "groups", "gaps", "local", "counts", "words"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, end = TaskContext.get().partitionId() << 32, np.zeros(1, np.int32)
        open_: dict[str, Filling] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if lang not in open_:
                    open_[lang] = Filling()
                held += open_[lang].add(tokens(text), end)
                while held >= HELD_BLOCKS * BLOCK_WORDS or (lang in open_ and open_[lang].words >= BLOCK_WORDS):
                    full = lang if lang in open_ and open_[lang].words >= BLOCK_WORDS else max(open_, key=lambda one: open_[one].weight)
                    mine = open_.pop(full)
                    held -= mine.weight
                    yield block(number, full, mine)
                    number += 1
        for one, mine in open_.items():
            yield block(number, one, mine)
            number += 1

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    return _kept(spark, rows.mapInPandas(scan, BLOCK + ", counts binary, words binary"), "occurrences-1")


def _ranges(blocks: DataFrame) -> int:
    return max(1, -(-(blocks.agg(F.sum("groups")).first()[0] or 0) // RANGE_GROUPS))


def _by_range(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(which, kind="stable")
    at = np.flatnonzero(np.append(True, which[order][1:] != which[order][:-1])) if which.size else []
    for a, b in zip(at, [*at[1:], which.size]):
        yield int(which[order[a]]), order[a:b]


FOUND = "block long, lang string, n long, local binary, gid binary, f binary, a binary, b binary, words binary"
_NAMES = ["block", "lang", "n", "local", "gid", "f", "a", "b", "words"]


def _answers(blocks: np.ndarray, local: np.ndarray, gid: np.ndarray) -> list[tuple]:
    """Rows that tell every block the numbers of its frequent groups; ``local`` ascends within a block."""
    return [
        (int(blocks[rows[0]]), None, 0, _steps(local[rows]), packed(gid[rows]), None, None, None, None)
        for _, rows in _by_range(np.unique(blocks, return_inverse=True)[1])
    ]


def frequent_words(spark: SparkSession, blocks: DataFrame, least: int) -> DataFrame:
    """Counts of all words over all blocks: rows of frequent words per key range (no block; ``n`` occurrences) and answers to
    blocks."""
    ranges = _ranges(blocks)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, lang, counts, words in zip(batch["block"], batch["lang"], batch["counts"], batch["words"]):
                words, counts = zlib.decompress(words).split(b"\n"), unpacked(counts)
                if not counts.size:
                    continue
                which = np.fromiter((xxhash.xxh64_intdigest(w) % ranges for w in words), np.int64, len(words))
                yield pd.DataFrame(
                    [
                        (r, number, lang, zlib.compress(b"\n".join([words[i] for i in rows]), 1), _steps(rows), packed(counts[rows]))
                        for r, rows in _by_range(which)
                    ],
                    columns=["range", "block", "lang", "words", "local", "counts"],
                )

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, base = [], 0
        for lang, mine in group.groupby("lang"):
            total = Numbering()
            lists = [zlib.decompress(w).split(b"\n") for w in mine["words"]]
            ids = np.concatenate([np.fromiter(map(total.__getitem__, w), np.int64, len(w)) for w in lists])
            f = np.bincount(ids, weights=np.concatenate([unpacked(c) for c in mine["counts"]]).astype(np.float64)).astype("<i8")
            names = list(total)
            chosen = sorted(np.flatnonzero(f >= least).tolist(), key=lambda i: (-f[i], names[i]))  # the same numbers in every attempt
            gid = np.full(f.size, -1, np.int64)
            gid[chosen] = (base + np.arange(len(chosen))) * ranges + key[0]
            base += len(chosen)
            if not chosen:
                continue
            out.append((-1, lang, int(f[chosen].sum()), None, packed(gid[chosen]), packed(f[chosen]), None, None, zlib.compress(b"\n".join(names[i] for i in chosen), 1)))
            blocks_ = np.repeat(mine["block"].to_numpy(np.int64), [len(w) for w in lists])
            local = np.concatenate([_stepped(x) for x in mine["local"]])
            hit = gid[ids] >= 0
            out += _answers(blocks_[hit], local[hit], gid[ids][hit])
        return pd.DataFrame(out, columns=_NAMES)

    dealt = blocks.select("block", "lang", "counts", "words").mapInPandas(
        deal, "range long, block long, lang string, words binary, local binary, counts binary"
    )
    return _kept(spark, dealt.groupBy("range").applyInPandas(add, FOUND), "frequent-1")


def _range_of(a: np.ndarray, b: np.ndarray, ranges: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % ranges


def frequent_pairs(spark: SparkSession, blocks: DataFrame, least: int, ranges: int, label: str) -> DataFrame:
    """As ``frequent_words``, of groups that are pairs of frequent ones, as the blocks have dealt them."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, base = [], 0
        for lang, mine in group.groupby("lang"):
            lists = [unpaired(*ab) for ab in zip(mine["a"], mine["b"])]
            (a, b), n = map(np.concatenate, zip(*lists)), np.concatenate([unpacked(x) for x in mine["counts"]])
            order = np.lexsort((b, a))
            new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
            starts = np.flatnonzero(new)
            f = np.add.reduceat(n[order], starts)
            chosen = np.flatnonzero(f >= least)
            if not chosen.size:
                continue
            chosen = chosen[np.argsort(-f[chosen], kind="stable")]
            gid = np.full(f.size, -1, np.int64)
            gid[chosen] = (base + np.arange(chosen.size)) * ranges + key[0]
            base += chosen.size
            head = order[starts[chosen]]
            out.append((-1, lang, int(f[chosen].sum()), None, packed(gid[chosen]), packed(f[chosen]), packed(a[head]), packed(b[head]), None))
            of_row = np.empty(a.size, np.int64)
            of_row[order] = gid[np.cumsum(new) - 1]
            hit = np.flatnonzero(of_row >= 0)
            sizes = [x.size for x, _ in lists]
            blocks_ = np.repeat(mine["block"].to_numpy(np.int64), sizes)
            local = np.concatenate([np.arange(x, x + size) for x, size in zip(mine["start"], sizes)])
            out += _answers(blocks_[hit], local[hit], of_row[hit])
        return pd.DataFrame(out, columns=_NAMES)

    dealt = blocks.select("block", "lang", F.inline("dealt"))
    return _kept(spark, dealt.groupBy("range").applyInPandas(add, FOUND), label)


def _pair_ranges(found: DataFrame) -> int:
    """Key ranges of pairs of frequent groups: there are no more pairs than occurrences, and two make a group at best."""
    return max(1, -(-(found.filter("block < 0").agg(F.sum("n")).first()[0] or 0) // (2 * RANGE_GROUPS)))


DEALT = "array<struct<range: long, start: long, a: binary, b: binary, counts: binary>>"


def extended(spark: SparkSession, blocks: DataFrame, found: DataFrame, ranges: int, label: str) -> DataFrame:
    """Semi-join of the blocks with their frequent groups, then the merge-join by neighbouring places: blocks of phrases
    one word longer, whose groups are pairs of frequent ones, numbered by key range and then by the numbers of the pair.
    ``dealt`` has the pairs of every range and the number of the first."""
    answers = found.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("local", "gid")).alias("answers"))  # groups of a block

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, lang, groups, gaps, local, answers in zip(*[batch[c] for c in ("block", "lang", "groups", "gaps", "local", "answers")]):
                gid = np.full(groups, -1, np.int64)
                for one in answers:
                    gid[_stepped(one["local"])] = unpacked(one["gid"])
                here = gid >= 0
                gids, dense = np.unique(gid[here], return_inverse=True)
                dense = np.where(here, dense[np.cumsum(here) - 1], -1)
                places, local = _stepped(gaps), dense[unpacked(local)]
                kept = local >= 0
                places, local = places[kept], local[kept]
                next_ = np.flatnonzero(places[1:] == places[:-1] + 1)
                pairs, back, counts = np.unique(local[next_] * gids.size + local[next_ + 1], return_inverse=True, return_counts=True)
                a, b = gids[pairs // gids.size], gids[pairs % gids.size]
                dealt = list(_by_range(_range_of(a, b, ranges)))
                order = np.concatenate([rows for _, rows in dealt] or [np.empty(0, np.int64)])
                starts = np.cumsum([0] + [rows.size for _, rows in dealt])
                yield pd.DataFrame(
                    [
                        (
                            number, lang, int(next_.size), int(pairs.size), _steps(places[next_]), packed(np.argsort(order)[back]),
                            [(r, int(start), *paired(a[rows], b[rows]), packed(counts[rows])) for (r, rows), start in zip(dealt, starts)],
                        )
                    ],
                    columns=["block", "lang", "n_all", "groups", "gaps", "local", "dealt"],
                )

    rows = blocks.select("block", "lang", "groups", "gaps", "local").join(answers, "block")
    return _kept(spark, rows.mapInPandas(extend, f"{BLOCK}, dealt {DEALT}"), label)


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, gid, f, words in zip(batch["lang"], batch["gid"], batch["f"], batch["words"]):
            yield pd.DataFrame({"gid": unpacked(gid), "lang": lang, "f": unpacked(f), "word": zlib.decompress(words).decode().split("\n")})


def _pair_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, gid, f, a, b in zip(batch["lang"], batch["gid"], batch["f"], batch["a"], batch["b"]):
            yield pd.DataFrame({"gid": unpacked(gid), "lang": lang, "f": unpacked(f), "a": unpacked(a), "b": unpacked(b)})


def _side(table: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    return table.select(F.col("gid").alias(name), *[F.col(c).alias(as_) for c, as_ in columns.items()])


def phrase_tables(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and the tables of frequent phrases of 2 words and more.

    A row has ``gid``, ``lang``, ``words``, ``f``, the overlapping phrases ``a`` and ``b`` it is made of with their counts
    ``fa`` and ``fb``, the counts ``fw``, ``fz`` of its first and last word, and ``fm``, ``fn``: the counts of the first
    and last but two words less, where there are.
    """
    blocks = occurrences(spark, docs)
    sizes = blocks.groupBy("lang").agg(F.sum("n_all").alias("n"))
    found = frequent_words(spark, blocks, least)
    rare = found.filter("block < 0")
    words = rare.select("lang", "gid", "f", "words").mapInPandas(_word_rows, "gid long, lang string, f long, word string")
    shorter = _kept(spark, words.select("gid", "lang", "f", F.array("word").alias("words"), F.col("f").alias("fw"), F.col("f").alias("fz"), F.col("f").alias("fa"), F.col("f").alias("fb")), "phrases-1")
    tables = []
    for k in range(2, longest + 1):
        ranges = _pair_ranges(found)
        blocks = extended(spark, blocks, found, ranges, f"occurrences-{k}")
        found = frequent_pairs(spark, blocks, least, ranges, f"frequent-{k}")
        pairs = found.filter("block < 0").select("lang", "gid", "f", "a", "b").mapInPandas(_pair_rows, "gid long, lang string, f long, a long, b long")
        left = _side(shorter, "a", {"words": "head", "f": "fa", "fw": "fw", "fa": "fm"})
        right = _side(shorter, "b", {"words": "tail", "f": "fb", "fz": "fz", "fb": "fn"})
        full = pairs.join(left, "a").join(right, "b").withColumn("words", F.concat("head", F.slice("tail", -1, 1))).drop("head", "tail")
        shorter = _kept(spark, full, f"phrases-{k}")
        tables.append(shorter)
    return sizes, tables


def _cuts(k: int) -> Column:
    """Counts of the parts of a phrase of ``k`` words, cut after each word in turn."""
    parts = {2: [("fw", "fz")], 3: [("fw", "fb"), ("fa", "fz")], 4: [("fw", "fb"), ("fm", "fn"), ("fa", "fz")]}[k]

    def cut(at: int, left: str, right: str) -> Column:
        whole = F.expr(f"cast({SCALE} * cast(f as decimal(20,0)) as decimal(28,0)) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0)))")
        return F.struct(whole.cast("long").alias("score"), F.lit(at).alias("at"), F.col(left).alias("l"), F.col(right).alias("r"))

    return F.array_min(F.array(*[cut(i, *p) for i, p in enumerate(parts, start=1)]))


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Best phrases of every language of ``docs`` (``lang``, ``text``): ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l``,
    ``r`` (counts of the parts of its lowest-scoring cut), ``n`` (words of the language), ``score``."""
    sizes, (two, three, four) = phrase_tables(spark, docs, least)
    parts = lambda table, *columns: table.select(F.explode(F.array(*columns)).alias("gid"), "f")
    of_four = four.select("f", "a", "b")
    inner_a = of_four.join(_side(three, "a", {"a": "aa", "b": "ab"}), "a").select("f", "aa", "ab")
    inner_b = of_four.join(_side(three, "b", {"b": "bb"}), "b").select("f", "bb")
    over = {
        2: parts(three, "a", "b").unionByName(parts(inner_a, "aa", "ab")).unionByName(parts(inner_b, "bb")),
        3: parts(four, "a", "b"),
    }
    chosen = None
    for k, table in ((2, two), (3, three), (4, four)):
        if k in over:
            longest = over[k].groupBy("gid").agg(F.max("f").alias("longer"))
            table = table.join(longest, "gid", "left").filter(f"longer is null or 100 * longer < {INSIDE} * f")
        rows = table.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), _cuts(k).alias("cut"))
        chosen = rows if chosen is None else chosen.unionByName(rows)
    chosen = chosen.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    apart = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))).orderBy(*order)
    first = chosen.withColumn("place", F.row_number().over(apart)).filter(F.col("place") <= top).drop("place")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def spoken(docs: DataFrame) -> DataFrame:
    """Language and text under fixed names, so that no other column can clash."""
    return docs.select(col("lang").cast("string").alias("lang"), col("text").cast("string").alias("text"))


_SQL = rf"""WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
  o AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
        FROM p, (VALUES (1), (2), (3), (4)) AS s(k)),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
  e AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
  x AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail FROM e),
  y AS (SELECT x.lang, x.phrase, x.cut, l.f AS l, r.f AS r, (({SCALE}::HUGEINT * x.a) // (l.f + r.f))::BIGINT AS score
        FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = x.head JOIN f AS r ON r.lang = x.lang AND r.phrase = x.tail),
  z AS (SELECT lang, phrase, l, r, score FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  w AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
        FROM c, (VALUES (2), (3)) AS s(m) WHERE m < k),
  g AS (SELECT lang, phrase, max(a) AS longer FROM w GROUP BY ALL),
  b AS (SELECT c.lang, c.phrase, c.a, z.l, z.r, z.score FROM c JOIN z ON z.lang = c.lang AND z.phrase = c.phrase
        LEFT JOIN g ON g.lang = c.lang AND g.phrase = c.phrase WHERE g.longer IS NULL OR 100 * g.longer < {INSIDE} * c.a),
  q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= {TOP}"""


@query("op13_setm_collocations", _SQL)
def op13_setm_collocations(spark, sf_dir):
    return collocations(spark, spoken(documents(spark, sf_dir)))
