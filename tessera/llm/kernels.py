"""Numpy pieces that run inside tasks: words of UTF-8 buffers and their Rabin-Karp hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Multi-byte characters have no byte
below 0x80, so this equals the character rule ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the prefix hashes (fixed values, free choice).
P_BYTE = 0x9E3779B97F4A7C15
P_WORD = 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 20


def tables():
    sep = np.zeros(256, dtype=bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    low = np.arange(256, dtype=np.uint8)
    low[ord("A") : ord("Z") + 1] += 32
    return sep, low


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict = {}


def powers(p: int, n: int):
    """p**i and p**-i modulo 2**64 for i < n; kept between calls, grown by doubling."""
    have = _POWERS.get(p)
    if have is None or len(have[0]) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        up, down = (np.full(m, q, dtype=np.uint64) for q in (p, pow(p, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _POWERS[p] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def buffer(arr: pa.Array):
    """Bytes and offsets of a string array (nulls are empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges whose texts hold about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray):
    """Start and end byte of each word, and first word of each text (length: texts + 1)."""
    sep, _ = tables()
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~sep[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word
    last = np.concatenate([word[:-1] & (~word[1:] | edge[1:n]), word[-1:]])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of each byte span, by prefix sums modulo 2**64."""
    up, down = powers(P_BYTE, len(buf) + 1)
    pre = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * down[starts])


def window_hashes(words: np.ndarray, first: np.ndarray, width: int, multiplier: int = P_WORD):
    """Hash of every run of ``width`` words inside one text, the index of its first word, and its text."""
    n = len(words)
    count = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    base = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    at = np.arange(int(count.sum()), dtype=np.int64) - base[text] + first[:-1][text]
    up, down = powers(multiplier, n + 1)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up[:n], out=pre[1:])
    return mix((pre[at + width] - pre[at]) * down[at]), at, text


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of one bigint column, as int64 (fixed values: the primes of xxHash)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = (np.uint64(seed) + p5 + np.uint64(8)) ^ (turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)
