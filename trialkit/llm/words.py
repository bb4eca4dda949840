"""Vectorised words of whole Arrow string columns: boundaries, 64-bit hashes and sums per document.

Texts are read as UTF-8 bytes. Work goes on in blocks cut between words, so memory follows the number of words of a
slice, not eight bytes per character of it. Equal words have equal hashes; different words differ but for chance (2^-64).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
SLICE_BYTES = 1 << 20


def table(is_word, lower: bool) -> np.ndarray:
    """For each byte 0 if it separates words, else a code above 0."""
    out = np.zeros(256, np.uint16)
    for b in range(256):
        c = b + 32 if lower and 65 <= b <= 90 else b
        if is_word(c):
            out[b] = c + 1
    return out


def _blank(b: int) -> bool:
    return b == 0x20 or 0x09 <= b <= 0x0D


BLANKS = table(lambda b: not _blank(b), lower=False)
BLANKS_LOWER = table(lambda b: not _blank(b), lower=True)
ALNUM_LOWER = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80, lower=True)
LINES = table(lambda b: b != 0x0A, lower=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Kept(dict):
    """What a process has worked out; functions sent to tasks take none of it along (two tables of 8 MB each)."""

    def __reduce__(self) -> tuple:
        return _Kept, ()


_powers: dict[int, np.ndarray] = _Kept()


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most `limit` bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of documents: hash, byte range in the data, where the words of each document begin, and hashes of prefixes (0 for
    shorter words) by their number of bytes."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    prefixes: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, offsets: np.ndarray, codes_of: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the documents data[offsets[i]:offsets[i + 1]]."""
    lo, stop = int(offsets[0]), int(offsets[-1])
    hashes, starts, ends = [], [], []
    clipped: dict[int, list[np.ndarray]] = {p: [np.zeros(0, np.uint64)] for p in prefixes}
    while lo < stop:
        hi, codes = lo, np.zeros(0, np.uint16)
        while True:  # a block ends after a separator or with a document
            more = min(hi + _BLOCK, stop)
            codes = np.concatenate([codes, codes_of[data[hi:more]]])
            hi = more
            if hi == stop:
                break
            gaps = np.flatnonzero(codes == 0)
            cut = max(lo + int(gaps[-1]) + 1 if len(gaps) else 0, int(offsets[np.searchsorted(offsets, hi, side="right") - 1]))
            if cut > lo:
                hi = cut
                codes = codes[: hi - lo]
                break
        inside = codes != 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        at = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi)] - lo
        begin[at] = inside[at]
        finish = inside
        finish[:-1] &= ~inside[1:] | begin[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        if len(s):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes.astype(np.uint64) * _power(_BASE, len(codes))[: len(codes)], out=sums[1:])
            back = _power(_INVERSE, len(codes))[s]
            h = (sums[e] - sums[s]) * back
            for p in prefixes:
                short = e - s < p
                own = mix((sums[np.where(short, e, s + p)] - sums[s]) * back + np.uint64(p * 0xA24BAED4963EE407 & (1 << 64) - 1))
                own[short] = 0
                clipped[p].append(own)
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            starts.append(s + lo)
            ends.append(e + lo)
        lo = hi
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), start, np.concatenate(ends) if ends else none,
        np.searchsorted(start, offsets), {p: np.concatenate(x) for p, x in clipped.items()},
    )


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of `size` words inside one document."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = words.doc
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words.hash[k : k + n] * np.uint64(_odd(k))
    return mix(h[at]), at


def _odd(k: int) -> int:
    return (pow(0xD1342543DE82EF95, k + 1, 1 << 64)) | 1


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values (one per byte or word) of each document."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        base = offsets[0]
        out[full] = np.add.reduceat(values, offsets[full] - base, dtype=np.int64)
    return out
