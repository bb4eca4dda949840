"""Reproducible draws: the same key gives the same position on any engine and any retry."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of md5 over the parts joined by '|', as a long."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_position(size: Column, *parts: Column | str) -> Column:
    """Uniform position in [0, size)."""
    return hash32(*parts) % size


# ---- many keys at once, inside a task --------------------------------------------------------------

# fixed values of md5: start, constants and rotations of its 64 steps
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_TENS = 10 ** np.arange(1, 19)
_LANES = 32_768


Part = bytes | np.ndarray | tuple[Sequence[bytes], np.ndarray]


def hash32_many(*parts: Part) -> np.ndarray:
    """`hash32` of many keys at once, as int64.

    A key is its parts put together, separators included: a text that all keys share, an array of integers from 0 on, or different texts with the
    number of each key's text.
    """
    n = next(len(p[1]) if isinstance(p, tuple) else len(p) for p in parts if not isinstance(p, bytes))
    out, layout, whole = np.empty(n, np.int64), np.zeros(n, np.int64), []
    for p in parts:
        if isinstance(p, bytes):
            whole.append((p, None, None))
        else:
            if isinstance(p, tuple):
                sizes = np.array([len(t) for t in p[0]], np.int64)
                table = np.zeros((len(p[0]), max(1, sizes.max(initial=0))), np.uint8)
                for row, t in zip(table, p[0], strict=True):
                    row[: len(t)] = np.frombuffer(t, np.uint8)
                values, sizes = p[1], sizes[p[1]]
            else:
                values, table, sizes = p, None, np.searchsorted(_TENS, p, side="right") + 1
            whole.append((values, table, sizes))
            if n and (low := sizes.min()) < (high := sizes.max()):
                layout = layout * (high - low + 1) + (sizes - low)
                if layout.max() > 1 << 15:
                    layout = np.unique(layout, return_inverse=True)[1]
    if not n:
        return out
    # keys of one layout are hashed together
    order = np.argsort(layout.astype(np.uint16) if layout.max() < 1 << 16 else layout, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(layout[order])) + 1):
        for lo in range(0, len(group), _LANES):
            at = group[lo : lo + _LANES]
            rows: list[int | np.ndarray] = []
            for values, table, sizes in whole:
                rows += values if sizes is None else _letters(values[at], table, int(sizes[at[0]]))
            out[at] = _md5_head(rows, len(at))
    return out


def _letters(values: np.ndarray, table: np.ndarray | None, length: int) -> list[np.ndarray]:
    """The bytes of texts or integers of one length, by place."""
    if table is not None:
        return [table[values, i].astype(np.uint32) for i in range(length)]
    rest, out = values.astype(np.uint32 if length < 10 else np.uint64), []
    for _ in range(length):
        left = rest // 10
        out.append((rest - left * 10).astype(np.uint32) + 48)
        rest = left
    return out[::-1]


def _md5_head(rows: list[int | np.ndarray], n: int) -> np.ndarray:
    """First 32 bits of md5 of n messages of one length, given byte by byte."""
    size = len(rows)
    rows = [*rows, 0x80, *[0] * (-(size + 9) % 64), *(8 * size).to_bytes(8, "little")]
    state: list[np.ndarray] = [np.full(n, v, np.uint32) for v in _START]
    for block in range(0, len(rows), 64):
        words = []
        for w in range(block, block + 64, 4):
            fixed = sum(r << 8 * i for i, r in enumerate(rows[w : w + 4]) if isinstance(r, int))
            moving = [r << 8 * i if i else r for i, r in enumerate(rows[w : w + 4]) if not isinstance(r, int)]
            words.append((fixed, sum(moving[1:], moving[0]) if moving else None))
        a, b, c, d = (s.copy() for s in state)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            fixed, moving = words[_WORD[i]]
            f += a
            f += np.uint32((_ADD[i] + fixed) & 0xFFFFFFFF)
            if moving is not None:
                f += moving
            np.right_shift(f, 32 - _TURN[i], out=t)
            f <<= _TURN[i]
            f |= t
            f += b
            a, b, c, d, f = d, f, b, c, a
        state = [s + v for s, v in zip(state, (a, b, c, d), strict=True)]
    return state[0].byteswap().astype(np.int64)
