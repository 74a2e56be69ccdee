"""k-mers as whole numbers of two bits a base, many at once, and their hashes: what tasks do with Arrow batches of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .md5 import md5_first
from .murmur import murmur3

#: The longest k-mer that a 64-bit number holds beside its bound.
MOST_K = 31
#: Positions that are worked on together.
POSITIONS = 1 << 16
#: Types of numbers, the narrowest first; a byte holds four bases.
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c | 32] = _i
#: Four bases, and two hexadecimal digits, by the byte that holds them.
_SPELLED = np.array([[b"ACGT"[i >> s & 3] for s in (6, 4, 2, 0)] for i in range(256)], np.uint8).view("<u4").ravel()
_DIGITS = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint16)


def _joined(one: np.ndarray, k: int, forward: bool) -> np.ndarray:
    """k neighbours as one number, by doubling; the first one highest, or lowest if not forward.  Short ones are put together in the narrowest type that holds them."""

    def both(first: np.ndarray, m: int, second: np.ndarray, w: int) -> np.ndarray:
        second = second[m:]
        first = first[: len(second)]
        kind = next(x for x in _WIDTHS if 4 * np.dtype(x).itemsize >= m + w)
        high, low, by = (first, second, 2 * w) if forward else (second, first, 2 * m)
        out = high.astype(kind)
        np.left_shift(out, kind(by), out=out)
        return np.bitwise_or(out, low, out=out)

    out, have, part, width = None, 0, one, 1
    while True:
        if k & width:
            out, have = (part, width) if out is None else (both(out, have, part, width), have + width)
        if 2 * width > k:
            return out
        part, width = both(part, width, part, width), 2 * width


def canonical(codes: np.ndarray, k: int) -> np.ndarray:
    """The lesser of each k-mer and its reverse complement, of codes 0 to 3 in the order of the letters."""
    short = codes.astype(np.uint8, copy=False)
    return np.minimum(_joined(short, k, True), _joined(np.uint8(3) - short, k, False)).astype(np.uint64, copy=False)


def kmers_of(values: pa.Array, k: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, k-mers) of blocks of positions: the canonical k-mers that hold A, C, G and T alone, and the places of their sequences among the values.

    wanted(k-mers) says which are, before their sequences are looked up.
    """
    values = values.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(values) or offsets[-1] - offsets[0] < k:
        return
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    for lo in range(0, len(data) - k + 1, POSITIONS):
        codes = _CODE[data[lo : lo + POSITIONS + k - 1]]
        numbers = canonical(codes & 3, k)
        whole = np.ones(len(numbers), bool) if wanted is None else wanted(numbers)
        if codes.max() > 3:
            other = np.concatenate(([0], np.cumsum(codes > 3)))
            whole &= other[k:] == other[:-k]
        near = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + len(codes), "left")]
        across = (np.unique(near)[:, None] - lo - np.arange(1, k)).ravel()
        whole[across[(across >= 0) & (across < len(whole))]] = False
        at = np.flatnonzero(whole)
        if len(at):
            yield np.searchsorted(ends, at + lo, "right"), numbers[at]


def spelled(kmers: np.ndarray, k: int) -> np.ndarray:
    """The letters of k-mers: a row of k bytes for each."""
    out = np.empty((len(kmers), -(-k // 4)), np.uint32)
    for i in range(out.shape[1]):
        by = 2 * (k - 4 * i - 4)
        part = kmers >> np.uint64(by) if by >= 0 else kmers << np.uint64(-by)
        out[:, i] = _SPELLED[(part & np.uint64(255)).astype(np.intp)]
    return out.view(np.uint8)[:, :k]


def hashes(kmers: np.ndarray, k: int, method: str) -> np.ndarray:
    """dna.hashed() of k-mers as numbers: 60 bits of md5, or 64 of murmur3."""
    rows = spelled(kmers, k)
    return md5_first(rows) >> np.uint64(4) if method == "md5" else murmur3(rows)[0]


def hex_digits(values: np.ndarray, digits: int) -> pa.Array:
    """Numbers as strings of so many hexadecimal digits."""
    whole = _DIGITS[values.astype(">u8").view(np.uint8)].view(np.uint8).reshape(len(values), 16)
    data = np.ascontiguousarray(whole[:, 16 - digits :])
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(digits)
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(data)])
