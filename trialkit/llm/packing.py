"""Packing of tokenised documents into windows by non-negative least squares over shallow length combinations.

Documents are cut at multiples of the window; what is left is a piece shorter than the window. Only the number of pieces of each length goes to
the driver, at most as many numbers as the window has places. Columns of the problem are combinations of at most two different
lengths that fill a window exactly; their repeat counts are fitted to the histogram by coordinate descent, rounded down to what the
histogram holds, and what is left over is packed greedily, longest first, cutting a piece only to fill a window to the brim. The result is
a table of ranges: pieces of one length with numbers from .. to lie in windows from .., which every piece looks up by its number. So the
size of the plan follows the window, not the corpus.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm import words
from trialkit.llm.frames import begin_task, end_task, resident, small_batches
from trialkit.session import broadcast_if_small, cut

WINDOW = 2048
END_ID = 1
#: what a worker remembers of runs seen
CACHE_IDS = 8_000_000
CACHE_RUNS = 1_000_000
_EXACT = 0x5851F42D4C957F2D
BATCH_PIECES = 8192
SWEEPS = 30
#: pieces of the shorter length in a combination
REPEATS = 3


# ---- tokens


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others by order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
#: every letter and mark of plain words; the shortcut is taken only if it agrees with the rules on all of these
_PROBES = [f"{x}{y}n{x}{mark}" for y in "ae" for x in "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])) for mark in ("", *".,;:!?", "...", "?!")]


def _bytewise(part: str) -> str:
    return part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)


class _Runs:
    """Ids of runs of characters between blanks, by the tokenizers library; known runs are looked up by their 64-bit hash.

    Runs of plain letters with marks behind them go to the merges directly, if that agrees with the rules on probes of every such letter and mark.

    The vocabulary's rules drop white space and never look across it, so the ids of a text are those of its runs, one after the other. Where the rules lower
    the case, runs that differ in the case of A-Z only are one; not so in slices that hold a special token, which is found before the case is lowered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = self.tokenizer.normalizer
        self.lowers = rules is not None and rules.normalize_str("A") == "a"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = all(self._by_model(w) == self._by_rules([w])[0] for w in _PROBES)
        self._clear()

    def _by_rules(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _by_model(self, text: str) -> list[int]:
        """Ids of letters and of the punctuation after them, each as one piece for the merges."""
        found = _PLAIN.fullmatch(text)
        return [t.id for part in found.groups() if part for t in self.tokenizer.model.tokenize(_bytewise(part))]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Plain words go straight to the merges, everything else through all rules."""
        out: list = [None] * len(texts)
        if self.plain:
            parts: dict[str, list[int]] = {}
            tokenize = self.tokenizer.model.tokenize
            for k, text in enumerate(texts):
                if found := _PLAIN.fullmatch(text.lower() if self.lowers else text):
                    word, mark = found.groups()
                    for part in (word, mark):
                        if part not in parts:
                            parts[part] = [t.id for t in tokenize(_bytewise(part))] if part else []
                    out[k] = parts[word] + parts[mark] if mark else parts[word]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._by_rules([texts[k] for k in rest])):
            out[k] = ids
        return out

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.ends = np.zeros(1 << 12, np.int64)

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        found = self._ids(texts)
        flat = np.fromiter(chain.from_iterable(found), np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while len(self.at) + len(found) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        n = len(self.at)
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(found)] = self.used + np.cumsum([len(ids) for ids in found])
        self.used += len(flat)
        self.at.update(zip(hashes, range(n, n + len(hashes))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents one after the other, and the number of ids of each."""
        if self.used > CACHE_IDS or len(self.at) > CACHE_RUNS:
            self._clear()
        base = int(offsets[0])
        raw = data[base : int(offsets[-1])].tobytes()
        exact = not self.lowers or any(t in raw for t in self.special)
        found = words.split(data, offsets, words.BLANKS if exact else words.BLANKS_LOWER)
        keys = found.hash ^ np.uint64(_EXACT if exact else 0)
        codes, unique = pd.factorize(keys)
        known = np.fromiter(map(self.at.get, unique.tolist(), repeat(-1)), np.int64, len(unique))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            places = first[missing]
            spans = zip((found.start[places] - base).tolist(), (found.end[places] - base).tolist())
            known[missing] = len(self.at) + np.arange(len(missing))
            self._learn(unique[missing].tolist(), [raw[lo:hi].decode("utf-8", "replace") for lo, hi in spans])
        run = known[codes]
        sizes = self.ends[run + 1] - self.ends[run]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.repeat(self.ends[run] - (upto - sizes), sizes) + np.arange(total)]
        return ids, words.per_document(sizes, found.first)


_held: dict[str, _Runs] = {}
resident("packing", _held.clear)


def _runs(path: str) -> _Runs:
    """The worker's cache; tasks of this kind that follow go on with it."""
    if path not in _held:
        _held.clear()
        _held[path] = _Runs(path)
    return _held[path]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def _nth(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each piece among the pieces of its length so far; adds them to `seen`."""
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    out = np.empty(len(lengths), np.int64)
    out[order] = seen[ranked] + np.arange(len(lengths)) - np.searchsorted(ranked, ranked)
    np.add.at(seen, lengths, 1)
    return out


def pieces(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(ident, doc_tokens, start, length, ids, part, nth): the ids of every document and `end_id`, cut at multiples of the window.

    ids is binary: little-endian unsigned 32-bit numbers. nth numbers the pieces of a length within a task (`part`).
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text"))
    long = T.LongType()
    fields = [("__id", docs.schema[ident].dataType), ("doc_tokens", long), ("start", long), ("length", long), ("ids", T.BinaryType()), ("part", long), ("nth", long)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("packing")
        runs, seen, part = _runs(tokenizer), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            for i, j in words.slices(at):
                ids, counts = _with_end(*runs.encode(data, at[i : j + 1]), end_id)
                parts = -(-counts // window)
                doc = np.repeat(np.arange(j - i), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, counts[doc] - start)
                nth = _nth(length, seen)
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                for lo in range(0, len(doc), BATCH_PIECES):
                    hi = min(lo + BATCH_PIECES, len(doc))
                    raw = ids[ends[lo] // 4 : ends[hi] // 4].astype("<u4").tobytes()
                    offsets = pa.py_buffer((ends[lo : hi + 1] - ends[lo]).astype(np.int32).tobytes())
                    own = doc[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(own + i)), pa.array(counts[own]), pa.array(start[lo:hi]), pa.array(length[lo:hi]),
                            pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(raw)]), pa.array(np.full(hi - lo, part)), pa.array(nth[lo:hi]),
                        ],
                        names=[n for n, _ in fields],
                    )
        end_task()

    return narrow.mapInArrow(run, schema).withColumnRenamed("__id", ident)


# ---- the plan


@dataclass
class Lot:
    """Pieces first .. first + count - 1 of an original length, of which only what begins at `start` is still to be placed."""

    origin: int
    start: int
    first: int
    count: int


class Plan:
    """Where the pieces lie. Rows: pieces first .. last - 1 of `origin`, of each the part start .. start + take - 1; `per` of them in each window
    from `sequence` on, side by side from `offset`; `skip` places are taken before the first."""

    COLUMNS = ("origin", "first", "last", "start", "take", "per", "skip", "sequence", "offset")

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        self.rows: list[tuple] = []
        self.lots = {n: [Lot(n, 0, 0, int(c))] for n, c in enumerate(histogram) if n and c}
        self.left = np.zeros(window + 1, np.int64)
        self.left[: len(histogram)] = histogram
        self.left[0] = 0
        self.sequences = 0

    def _take(self, length: int, count: int) -> Iterator[Lot]:
        self.left[length] -= count
        lots = self.lots[length]
        while count:
            lot = lots[-1]
            n = min(count, lot.count)
            yield Lot(lot.origin, lot.start, lot.first, n)
            lot.first, lot.count, count = lot.first + n, lot.count - n, count - n
            if not lot.count:
                lots.pop()

    def fill(self, parts: list[tuple[int, int]], repeat: int, cut_length: int = 0) -> None:
        """`repeat` windows, each with the given numbers of pieces (length, number); a piece of `cut_length` fills what is left, its rest goes back."""
        offset = 0
        for length, per in parts:
            skip = 0
            for lot in self._take(length, per * repeat):
                self.rows.append((lot.origin, lot.first, lot.first + lot.count, lot.start, length, per, skip, self.sequences, offset))
                skip += lot.count
            offset += per * length
        if cut_length:
            room, skip = self.window - offset, 0
            rest = cut_length - room
            for lot in list(self._take(cut_length, repeat)):
                self.rows.append((lot.origin, lot.first, lot.first + lot.count, lot.start, room, 1, skip, self.sequences, offset))
                skip += lot.count
                self.lots.setdefault(rest, []).append(Lot(lot.origin, lot.start + room, lot.first, lot.count))
                self.left[rest] += lot.count
        self.sequences += repeat

    def end(self, parts: list[tuple[int, int]]) -> None:
        """The last tokens, in sequences of powers of two, which need no padding."""
        room, offset = 0, 0
        left = sum(n * per for n, per in parts)
        for length, per in parts:
            for lot in list(self._take(length, per)):
                for number in range(lot.first, lot.first + lot.count):
                    start, todo = lot.start, length
                    while todo:
                        if not room:
                            room, offset = 1 << (left.bit_length() - 1), 0
                            self.sequences += 1
                        n = min(room, todo)
                        self.rows.append((lot.origin, number, number + 1, start, n, 1, 0, self.sequences - 1, offset))
                        start, todo, room, offset, left = start + n, todo - n, room - n, offset + n, left - n


def combinations(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(a, m, b, k): m pieces of length a and k of length b fill a window; at most two lengths that occur, and at most `REPEATS` of the second."""
    here = [int(n) for n in np.flatnonzero(histogram) if 0 < n <= window]
    known = set(here)
    out = []
    for a in reversed(here):
        for m in range(1, window // a + 1):
            rest = window - m * a
            if not rest:
                out.append((a, m, a, 0))
                continue
            for k in range(1, REPEATS + 1):
                b, over = divmod(rest, k)
                if not over and b in known and b != a and not (m <= REPEATS and b > a):
                    out.append((a, m, b, k))
    return out


def solve(columns: list[tuple[int, int, int, int]], histogram: np.ndarray, sweeps: int = SWEEPS) -> list[float]:
    """Repeat counts x >= 0 that bring the columns nearest to the histogram: least squares by coordinate descent."""
    rest = [float(c) for c in histogram]
    x = [0.0] * len(columns)
    scale = max(1.0, sum(rest))
    for _ in range(sweeps):
        moved = 0.0
        for p, (a, m, b, k) in enumerate(columns):
            step = max(-x[p], (m * rest[a] + k * rest[b]) / (m * m + k * k))
            if step:
                x[p] += step
                rest[a] -= m * step
                rest[b] -= k * step
                moved += abs(step)
        if moved < 1e-6 * scale:
            break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Fitted combinations, as many as their rounded counts and the histogram allow, then the rest greedily."""
    made = Plan(histogram, window)
    columns = combinations(histogram, window)
    found = solve(columns, histogram)
    for p in sorted(range(len(columns)), key=lambda p: -found[p]):
        a, m, b, k = columns[p]
        n = min(int(found[p] + 1e-9), int(made.left[a]) // m)
        if k:
            n = min(n, int(made.left[b]) // k)
        if n:
            made.fill([(a, m), (b, k)] if k else [(a, m)], n)
    made.fitted = made.sequences
    while made.left.any():
        parts, room = [], window
        left = made.left.copy()
        while room:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = min(int(left[length]), room // length)
            parts.append((length, n))
            left[length] -= n
            room -= n * length
        larger = np.flatnonzero(left)
        if room and not len(larger):
            made.end(parts)
            break
        split = int(larger[0]) if room else 0
        need = dict(parts)
        if split:
            need[split] = need.get(split, 0) + 1
        made.fill(parts, min(int(made.left[n]) // c for n, c in need.items()), split)
    return made


# ---- the operator


def pack(
    docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: ident, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every window is full; the last tokens of the table stand in sequences of powers of two, so nothing is padded. Null and empty texts are
    the end id alone. A null ident is kept as it is; repeated rows are documents of their own. Very long texts become many full windows and one rest;
    a run without blanks is encoded in one go. Other columns are not read. No rows in, no rows out.
    """
    cut_up = cut(pieces(docs, tokenizer, ident, text, window, end_id))
    counts = cut(cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row per length at most
        histogram[length] = n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut_up.join(broadcast_if_small(bases, counts.count(), 48), ["part", "length"]).withColumn("number", F.col("nth") + F.col("base"))
    made = plan(histogram, window)
    columns = ["origin", "number_from", "number_to", "piece_start", "take", "per", "skip", "sequence", "place"]
    rows = docs.sparkSession.createDataFrame(made.rows, ", ".join(f"{c} long" for c in columns))
    inside = (F.col("length") == F.col("origin")) & (F.col("number") >= F.col("number_from")) & (F.col("number") < F.col("number_to"))
    placed = numbered.join(F.broadcast(rows), inside)  # bounded by the window, not by the documents
    nth = F.col("skip") + F.col("number") - F.col("number_from")
    return placed.select(
        ident, (F.col("start") + F.col("piece_start")).alias("start"), F.col("take").alias("length"),
        F.substring("ids", (F.col("piece_start") * 4 + 1).cast("int"), (F.col("take") * 4).cast("int")).alias("ids"), "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("per"))).alias("sequence_id"), (F.col("place") + F.pmod(nth, F.col("per")) * F.col("take")).alias("offset"),
    )
