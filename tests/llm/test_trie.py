"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def plain(rows, rebuilt=True):
    """Nodes by definition: every prefix of every conversation."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        convs[c] = own.get(c - c % 20, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0)
    out = []
    for p, m in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends))
    return sorted(out, key=str)


def made(spark, rows, partitions=None, rebuilt=True):
    s = P.sequences(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in P.trie(P.rebuild(s) if rebuilt else s, partitions).collect()), key=str)


def talk(rng, n, words=3, turns=9):
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("abc") for _ in range(rng.randint(0, words))), "x") for c in range(n) for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("partitions", [None, 1, 2, 7, 130])
def test_equals_all_prefixes(spark, partitions, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3 if partitions == 7 else 64)
    rows = talk(random.Random(partitions or 0), 300 if partitions == 130 else 150, words=1, turns=6)
    assert made(spark, rows, partitions) == plain(rows)


def test_hostile_rows(spark):
    rows = [(c, None if t == 0 else t, r, x, "k") for c in (0, 3, 17, 19, 21, 40, 45, -7, -20) for t, (r, x) in enumerate([("user", "a b"), (None, None), ("a", "1:ser"), ("", "a\n")][: c % 4 + 1])]
    rows += [(60, 1, "user", "same"), (60, 1, "user", "same"), (60, 1, "assistant", "x"), (None, 1, "user", "lost"), (61, 0, "user", "long " * 50_000)]
    rows = [(*r[:4], "k") for r in rows if r[0] is None or r[0] >= 0]
    assert made(spark, rows) == plain(rows)
    assert made(spark, []) == []


def test_long_and_hot_conversations(spark):
    """One conversation of 5,000 turns with branches, and 2,000 copies of one conversation, over many partitions."""
    long = [(1, t, "user", f"turn {t}", "k") for t in range(5_000)]
    branch = [(2, t, "user", f"turn {t}" if t < 2_500 else "other", "k") for t in range(2_600)] + [(3, t, "user", f"turn {t}", "k") for t in range(4_000)]
    hot = [(10 + c, t, "user", "the same opening", "k") for c in range(2_000) for t in range(2)] + [(5_000 + c, t, "user", "the same opening" if t == 0 else f"then {c}", "k") for c in range(1_000) for t in range(2)]
    rows = long + branch + hot
    got = made(spark, rows, 40, rebuilt=False)
    want = defaultdict(int)
    assert len({(r[0], r[1]) for r in got}) == len(got) == 1 + 5_000 + 100 + 1 + 1 + 1_000
    for r in got:
        want[r[1]] += 1
    root = next(r for r in got if r[1] == 0)
    assert root[:5] == (1, 0, None, 3_003, 2) and root[5] == 2 + 1 + 1_000
    at = {(r[0], r[1]): r for r in got}
    assert at[1, 2_500][3:5] == (3, 2) and at[1, 2_501][3:5] == (2, 1) and at[1, 4_000][3] == 2 and at[1, 4_001][3] == 1
    assert at[10, 1][3:6] == (3_000, 1_001, 1_001) and at[10, 1][6] == 2_999 * 3 + 1_999 * 3
    assert at[10, 2][7] == hashlib.sha256(",".join(str(10 + c) for c in range(2_000)).encode()).hexdigest()
