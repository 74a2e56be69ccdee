"""MurmurHash3 (x64, 128 bits) of many short byte strings at once, for sketches that other tools have made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the seed of sketches.
SEED = 42
#: Fixed values of the hash.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * MIX1
    x = (x ^ x >> np.uint64(33)) * MIX2
    return x ^ x >> np.uint64(33)


def murmur3(rows: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash of each row of bytes, all rows of one length."""
    n, size = rows.shape
    whole = np.zeros((n, -(-size // 16) * 16), np.uint8)  # the last block ends in zeros, which add nothing
    whole[:, :size] = rows
    words = whole.view("<u8")
    first, second = np.full(n, seed, np.uint64), np.full(n, seed, np.uint64)
    for block in range(words.shape[1] // 2):
        a = _turned(words[:, 2 * block] * C1, 31) * C2
        b = _turned(words[:, 2 * block + 1] * C2, 33) * C1
        first ^= a
        if 16 * (block + 1) > size:
            second ^= b
            break
        first = (_turned(first, 27) + second) * np.uint64(5) + np.uint64(0x52DCE729)
        second ^= b
        second = (_turned(second, 31) + first) * np.uint64(5) + np.uint64(0x38495AB5)
    first, second = first ^ np.uint64(size), second ^ np.uint64(size)
    first = first + second
    second = second + first
    first, second = _spread(first), _spread(second)
    first = first + second
    return first, second + first


def first_halves(values: list[bytes], seed: int = SEED) -> np.ndarray:
    """The first 64 bits of the hash of each value, of any lengths."""
    sizes = np.array([len(v) for v in values], np.int64)
    out = np.zeros(len(values), np.uint64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(values[i] for i in own), np.uint8).reshape(len(own), size)
        out[own] = murmur3(raw, seed)[0]
    return out


def murmur_hex(value: Column) -> Column:
    """The first 64 bits of the hash of binary values, as 16 hex digits; null stays null."""

    @F.pandas_udf(StringType())
    def hexed(values: pd.Series) -> pd.Series:
        found = first_halves([bytes(v) if v is not None else b"" for v in values])
        return pd.Series([None if v is None else format(h, "016x") for v, h in zip(values, found.tolist(), strict=True)], dtype=object)

    return hexed(value)
