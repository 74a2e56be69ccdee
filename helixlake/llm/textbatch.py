"""Vectorised text helpers that run inside Spark tasks.

Everything here works on one Arrow batch (or one slice of it) at a time, so the
memory of a task is bounded by the batch, not by the table.  Texts are joined
into one buffer, and prefix sums over the buffer give the hash of any token or
window as a difference of two numbers, without a Python loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Fixed random value of each byte; equal in all workers.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) for i below n, modulo 2**64."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, INVERSE if inverse else BASE, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of value(data[j]) * BASE**j over j < i, for bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data)), out=out[1:], dtype=np.uint64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end of a buffer; equal bytes have equal hashes."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`; a longer row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts, a line feed after each, and the offsets of the texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    return data, np.concatenate([np.zeros(1, np.int64), ends])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not ASCII white space."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
