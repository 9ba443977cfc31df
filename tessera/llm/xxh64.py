"""XXH64 over many slices of one buffer at once (the public algorithm, in numpy vector operations)."""

from __future__ import annotations

import numpy as np

# Fixed values of the algorithm.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotl(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def slices(buffer: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """The unsigned hashes of ``buffer[start[i]:end[i]]``."""
    if not len(start):
        return np.empty(0, np.uint64)
    raw = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    u64 = np.lib.stride_tricks.as_strided(raw.view(np.uint8)[:8].view("<u8"), (len(buffer) + 1,), (1,))
    u32 = np.lib.stride_tricks.as_strided(raw[:4].view("<u4"), (len(buffer) + 1,), (1,))
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        at, size = start.astype(np.int64), (end - start).astype(np.int64)
        acc = np.full(len(at), seed + P5, np.uint64)
        rows = np.flatnonzero(size >= 32)
        if len(rows):
            v = [np.full(len(rows), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            stripes, p = size[rows] // 32, at[rows]
            for i in range(int(stripes.max())):
                on = np.flatnonzero(stripes > i)
                q = p[on] + 32 * i
                for j in range(4):
                    v[j][on] = _round(v[j][on], u64[q + 8 * j])
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.uint64(0), x)) * P1 + P4
            acc[rows] = h
        acc += size.astype(np.uint64)
        at = at + size // 32 * 32
        rest = size % 32
        for i in range(3):
            on = np.flatnonzero(rest >= 8 * (i + 1))
            acc[on] = _rotl(acc[on] ^ _round(np.uint64(0), u64[at[on] + 8 * i]), 27) * P1 + P4
        at, rest = at + rest // 8 * 8, rest % 8
        on = np.flatnonzero(rest >= 4)
        acc[on] = _rotl(acc[on] ^ u32[at[on]].astype(np.uint64) * P1, 23) * P2 + P3
        at, rest = at + rest // 4 * 4, rest % 4
        for i in range(3):
            on = np.flatnonzero(rest > i)
            acc[on] = _rotl(acc[on] ^ raw[at[on] + i].astype(np.uint64) * P5, 11) * P1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        return acc ^ (acc >> np.uint64(32))
