"""Hashes of words and word shingles of many texts at once, by vector operations over their bytes."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20_240_611)
#: A random 64-bit value per byte and per place in a shingle, and an odd base.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed in one go; a text of any length is worked through in such parts.
PART = 1 << 21
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PART + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of bytes that end with white space."""
    white = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return starts, _mix((total[ends] - total[starts]) * inverse[starts])


def word_hashes(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + PART, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:
            # to the end of the word
            more = np.flatnonzero(_SPACE[data[end : end + PART]])
            end = end + int(more[0]) + 1 if len(more) else min(end + PART, len(data))
        s, h = _words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    all_starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
    bounds = np.searchsorted(all_starts, np.concatenate([[0], np.cumsum(sizes)]))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), bounds


def shingle_hashes(texts: list[str | None], k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and where each text's begin; a shorter text's words are one shingle."""
    words, bounds = word_hashes(texts, lower)
    counts = np.diff(bounds)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(int(each.sum()), np.uint64)
    first = np.concatenate([[0], np.cumsum(each)])
    if len(words) >= k:
        run = words[: len(words) - k + 1] * _PLACE[0]
        for j in range(1, k):
            run = run + words[j : len(words) - k + 1 + j] * _PLACE[j]
        long_ = np.flatnonzero(counts >= k)
        at = np.repeat(bounds[long_] - first[long_], each[long_]) + np.flatnonzero(np.repeat(counts >= k, each))
        out[np.repeat(counts >= k, each)] = run[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[bounds[i] : bounds[i + 1]]
        out[first[i]] = (own * _PLACE[8 : 8 + len(own)]).sum(dtype=np.uint64) + _PLACE[15 - len(own)]
    return _mix(out), first


def shingle_sets(texts: list[str | None], k: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    hashes, first = shingle_hashes(texts, k, lower)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def in_parts(texts: list, limit: int = 4 << 20):
    """Runs of rows of about limit signs, for bounded memory."""
    begin = n = 0
    for i, t in enumerate(texts):
        n += len(t) if t else 0
        if n >= limit:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
