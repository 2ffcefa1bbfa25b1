"""Randomness as a pure function of keys.

Every random choice is an md5 of integers and strings, so a job gives the same rows after
an executor is lost, on any number of partitions, and in any engine that has md5.
Never pass doubles or timestamps: their text form differs between engines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 4294967296


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash32(*parts) -> Column:
    """Uniform integer in [0, 2^32) from the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *map(_text, parts))), 1, 8), 16, 10).cast("bigint")


def stable_seed(*parts, base: int = 42, version: str = "v1") -> Column:
    """Seed in [0, 2^32): leading four bytes of the SHA-256 of version, base and parts."""
    text = F.concat_ws("|", F.lit(version), F.lit(str(base)), *map(_text, parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def pick(n: Column, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(hash32(*parts), n.cast("bigint"))


#: Rows hashed at a time, so that they stay near the processor.
_ROWS = 1 << 16
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64)


def _md5_heads(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of n one-block messages given as 16 little-endian words (or one for all)."""
    out = np.empty(n, np.uint32)
    for low in range(0, n, _ROWS):
        m = min(_ROWS, n - low)
        own = [w[low : low + m] if isinstance(w, np.ndarray) else int(w) for w in words]
        a, b, c, d = (np.full(m, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        f, g = np.empty(m, np.uint32), np.empty(m, np.uint32)
        for i in range(64):
            if i < 16:
                at = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                at = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                at = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                at = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            f += a
            if isinstance(own[at], np.ndarray):
                f += own[at]
                f += np.uint32(_SINES[i])
            else:
                f += np.uint32((int(_SINES[i]) + own[at]) % UINT32)
            shift = _SHIFTS[i // 16][i % 4]
            np.left_shift(f, np.uint32(shift), out=g)
            np.right_shift(f, np.uint32(32 - shift), out=f)
            np.bitwise_or(f, g, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        a += np.uint32(0x67452301)
        out[low : low + m] = a.byteswap()
    return out


def _hashed(head: bytes, bodies: np.ndarray) -> np.ndarray:
    """hash32 of head followed by each row of bytes; at most 55 bytes in all."""
    n, size = len(bodies), len(head) + bodies.shape[1]
    first, last = len(head) // 4, size // 4
    message = np.zeros((n, 4 * last + 4), np.uint8)
    message[:, : len(head)] = np.frombuffer(head, np.uint8)
    message[:, len(head) : size] = bodies
    message[:, size] = 0x80
    columns = np.ascontiguousarray(message.view("<u4").T)
    words = [columns[i] if first <= i else int(columns[i, 0]) for i in range(last + 1)] + [0] * (15 - last)
    words[14] = 8 * size
    return _md5_heads(words, n)


def hash32_texts(head: str, texts: pa.Array) -> np.ndarray:
    """hash32(*head, text) of many texts at once; head: the parts before, joined by '|'. A null text is left out."""
    texts = texts.cast(pa.large_string())
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    before, sizes = head.encode() + b"|", np.diff(offsets)
    out = np.empty(len(texts), np.uint32)
    out[~known] = int(hashlib.md5(head.encode()).hexdigest()[:8], 16)
    for size in np.unique(sizes[known]).tolist():
        rows = np.flatnonzero(known & (sizes == size))
        bodies = data[offsets[rows][:, None] + np.arange(size)]
        if len(before) + size <= 55:
            out[rows] = _hashed(before, bodies)
        else:
            out[rows] = [int(hashlib.md5(before + x.tobytes()).hexdigest()[:8], 16) for x in bodies]
    return out


def hash32_numbers(head: str, low: int, high: int) -> np.ndarray:
    """hash32(*head, i) of the whole numbers low <= i < high (0 or more)."""
    before, out, start = head.encode() + b"|", [np.empty(0, np.uint32)], low
    while start < high:
        size = len(str(start))
        end = min(high, 10**size)
        if len(before) + size > 55:
            out.append(np.array([int(hashlib.md5(before + str(i).encode()).hexdigest()[:8], 16) for i in range(start, end)], np.uint32))
        else:
            rest, digits = np.arange(start, end, dtype=np.uint32 if end < UINT32 else np.uint64), np.empty((end - start, size), np.uint8)
            for i in range(size - 1, -1, -1):
                above = rest // 10
                digits[:, i] = rest - above * 10 + 48
                rest = above
            out.append(_hashed(before, digits))
        start = end
    return np.concatenate(out)
