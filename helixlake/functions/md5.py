"""MD5 of many short byte strings at once, for the hashes of k-mers."""

from __future__ import annotations

import numpy as np

#: Fixed values of the hash: turns, constants and the state it starts from.
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
ADDED = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a string that fit in one block beside its end and its length.
MOST = 55


def _word(step: int) -> int:
    """The word of the message that a step takes."""
    return (step, 5 * step + 1, 3 * step + 5, 7 * step)[step // 16] % 16


def md5_first(rows: np.ndarray) -> np.ndarray:
    """The first 64 bits (big-endian, as the hex digits read) of the MD5 of each row of bytes, all rows of one length."""
    n, size = rows.shape
    if size > MOST:
        raise ValueError(f"more than {MOST} bytes")
    used = size // 4 + 1
    block = np.zeros((n, 4 * used), np.uint8)
    block[:, :size] = rows
    block[:, size] = 0x80
    words: list = list(np.ascontiguousarray(block.view("<u4").T)) + [None] * (16 - used)  # the others are 0 but for the length
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for step in range(64):
        kind = step // 16
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        at = _word(step)
        np.add(f, a, out=f)
        np.add(f, np.uint32((ADDED[step] + (8 * size if at == 14 else 0)) % 2**32), out=f)
        if words[at] is not None:
            np.add(f, words[at], out=f)
        turn = TURNS[kind][step % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    high = (a + np.uint32(START[0])).byteswap().astype(np.uint64)
    return high << np.uint64(32) | (b + np.uint32(START[1])).byteswap()
