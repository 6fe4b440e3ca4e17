"""Damaged archives of one member, and scans of very long texts."""

import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity, warc


def records(n, seed=0):
    rng = random.Random(seed)
    bodies = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 400))).encode() for _ in range(n)]
    return [warc.record(i, f"http://h/{i}", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)]


def found(data):
    rows = list(warc.salvage(data))
    assert sum(r["length"] for r in rows) == len(data)
    spans = sorted((r["offset"], r["offset"] + r["length"]) for r in rows if r["length"])
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    return [r["page_id"] for r in rows if r["kind"] == "record"], [r for r in rows if r["kind"] == "gap"]


def damages(packed):
    flip = lambda d, at: d[:at] + bytes([d[at] ^ 255]) + d[at + 1 :]
    return {"crc": flip(packed, len(packed) - 6), "late": flip(packed, len(packed) * 9 // 10), "cut": packed[:-100], "early": flip(packed, len(packed) // 10)}


@pytest.mark.parametrize("what", ["crc", "late", "cut", "early"])
@pytest.mark.parametrize("after", [0, 1])
def test_a_member_of_many_records_keeps_those_before_the_fault(what, after):
    """200 records in one member; with and without whole members that follow it."""
    parts = records(200)
    packed = gzip.compress(b"".join(parts), mtime=0)
    more = records(205)[200:]
    data = damages(packed)[what] + b"".join(gzip.compress(x) for x in more) * after
    ids, gaps = found(data)
    inside = [i for i in ids if i < 200]
    assert ids == inside + list(range(200, 205)) * after and sum(g["length"] > 0 for g in gaps) <= 1 <= len(gaps)
    # what inflates before the fault is whole
    sizes = np.cumsum([len(x) for x in parts])
    start = {"crc": len(packed), "late": len(packed) * 9 // 10, "cut": len(packed) - 100, "early": len(packed) // 10}[what]
    before = len(zlib.decompressobj(31).decompress(packed[:start])) if what != "crc" else sizes[-1]
    sure = int(np.searchsorted(sizes, before, "right"))
    assert set(range(sure)) <= set(inside) and (what != "crc" or inside == list(range(200))) and sure >= {"crc": 200, "late": 150, "cut": 150, "early": 5}[what]


def test_large_members_are_inflated_piece_by_piece():
    """Three megabytes in a member, damaged late: many feeds before the fault."""
    rng = np.random.default_rng(0)
    bodies = [rng.bytes(30_000) for _ in range(100)]
    packed = gzip.compress(b"".join(warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)), 1)
    hurt = bytearray(packed)
    hurt[-40_000:-39_000] = bytes(1000)
    began = time.time()
    ids, gaps = found(bytes(hurt))
    assert len(ids) >= 98 and gaps and sum(g["length"] for g in gaps) < 100_000 and time.time() - began < 20


def test_segments_equal_the_recursion():
    rng = np.random.default_rng(1)
    for _ in range(200):
        score = rng.normal(-0.3, 1, rng.integers(1, 25))
        got, want = toxicity.segments(score), []
        todo = [(0, score)]
        while todo:
            off, s = todo.pop()
            if not (s > 0).any():
                continue
            total = np.concatenate([[0.0], np.cumsum(s)])
            v, i, j = max((total[j] - total[i], i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
            want.append((off + i, off + j, v))
            todo += [(off, s[:i]), (off + j, s[j:])]
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and np.allclose([x[2] for x in got], [x[2] for x in sorted(want)])


@pytest.mark.parametrize("drift", [-0.5, -0.01, 0.01])
def test_a_million_tokens_are_scanned_in_a_second_or_so(drift):
    """A fifth of the tokens positive, drifting down, level or up."""
    rng = np.random.default_rng(2)
    score = np.where(rng.random(1_000_000) < 0.2, 1.0, -0.25 + drift)
    began = time.time()
    toxicity.segments(score)
    assert time.time() - began < 10
