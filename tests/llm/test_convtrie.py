"""Prefix trie of conversations: Z-fast tries against sets of prefixes, the whole table against plain Python."""

import hashlib
import random
import zlib

import pytest

from lakewarden.llm import convtrie
from lakewarden.llm.convtrie import WIDE, ZFastTrie


def blob(path):
    hashes, last = [], b""
    for step in path:
        last = hashlib.sha256(last + step.encode()).digest()[:WIDE]
        hashes.append(last)
    return b"".join(hashes)


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            want = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert convtrie.fattest(low, high) == want


@pytest.mark.parametrize("seed, letters, longest, batch", [(1, "ab", 6, 1), (2, "ab", 12, 7), (3, "abc", 40, 50), (4, "a", 70, 3), (5, "abcdef", 4, 500)])
def test_trie_holds_all_prefixes(seed, letters, longest, batch):
    rng = random.Random(seed)
    paths = [[rng.choice(letters) for _ in range(rng.randint(1, longest))] for _ in range(300)]
    paths += [p[: rng.randint(1, len(p))] + [rng.choice(letters)] for p in paths[:150]]
    items = [(i * 7919 % 1000, blob(p)) for i, p in enumerate(paths)]
    trie = ZFastTrie()
    for a in range(0, len(items), batch):
        trie.insert(items[a : a + batch])
    for _, b in items:  # every path leaves at its own end
        node = trie.exit_node(b)
        assert trie.extent[node] * WIDE >= len(b) and trie.blob[node][: len(b)] == b
    want = {}
    for conv, b in items:
        for d in range(len(b) // WIDE + 1):
            key = (d, b[WIDE * (d - 1) : WIDE * d] if d else bytes(WIDE))
            least, followed = want.get(key, (conv, False))
            want[key] = (min(least, conv), followed or d < len(b) // WIDE)
    rows = trie.expanded()
    got = {
        (d, h1.to_bytes(8, "little", signed=True) + h2.to_bytes(8, "little", signed=True)): (l, f)
        for d, h1, h2, l, f in zip(*[rows[c].tolist() for c in ("depth", "h1", "h2", "least", "followed")])
    }
    assert len(rows) == len(got) and got == want


def plain(turns):
    """Nodes by the rules, over rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(rows)] for c, rows in own.items()}
    members = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c, end in sorted(who) if end)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        leaves = sum(1 for p in below if not any(q[:-1] == p for q in below if q))
        parent = min(members[path[:-1]])[0] if path else None
        children = sum(1 for p in below if len(p) == len(path) + 1)
        out.append((min(who)[0], len(path), parent, len(who), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows, extra=False):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "z", 1) if extra else r for r in rows], schema + (", blob string, base long" if extra else ""))
    return sorted((tuple(r) for r in convtrie.prefix_trie(spark, convtrie.turns_only(df)).collect()), key=repr)


def test_whole_table(spark, small):
    rows = [tuple(r) for r in convtrie.conversations(spark, small).collect()]
    assert nodes(spark, rows) == plain(rows)


def test_edge_cases(spark):
    rows = [(5, 0, "user", "hello"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, None, None), (5, 1, "", ""), (6, 0, "user", "hello"),
            (7, 3, "user", "é" * 5000), (7, 2, "a", "b"), (-3, 1, "user", "below"), (-3, 2, "user", "zero"), (0, 1, "user", "below"),
            (11, 0, "u", "no base"), (11, 1, "u", "still none"), (None, 0, "user", "nobody"), (10**15, 1, "u", "far"), (10**15 + 1, 9, "u", "far")]
    assert nodes(spark, rows, extra=True) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    no_base = [c for c in range(1, 400) if c % 5 and convtrie.head_turns(c) >= 2][:3]
    rows = [(c, t, "u", f"t{t}") for c in no_base for t in range(2)]
    got = nodes(spark, rows)
    assert got == plain(rows) and len(got) == 1 and got[0][3] == 3


def test_shared_paths_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "SLICE_TURNS", 7)
    monkeypatch.setattr(convtrie, "BATCH", 2)
    rng = random.Random(11)
    rows = [(c, t, "u", rng.choice("xyz")) for c in range(90) for t in range(rng.randint(1, 12))]
    assert nodes(spark, rows) == plain(rows)


def test_end_blocks_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "END_RANGE", 3)
    rows = [(c, 0, "u", "same") for c in (-12, -1, 0, 2, 9, 10, 11, 100, 1000)]
    assert nodes(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert nodes(spark, []) == []
