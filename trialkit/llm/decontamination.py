"""Benchmark passages in documents by multi-pattern search with shift tables, over words.

Patterns are the word windows of the benchmark. For patterns of one length, a table tells for each pair of words (a block) how far the
search may move on: not at all if some pattern ends with the block, else to where the block could be part of a pattern, else past it.
Where the shift is 0, the patterns that end and begin like the text are looked up by the hash of both blocks, and a direct comparison of
the words confirms. All documents of a slice are searched at the same time, in lanes.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm import words
from trialkit.llm.frames import free_name, map_texts

WINDOW = 13
BLOCK_BYTES = 8 << 20
_SHIFT_BITS = 18
_LANE = 192
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FIRST, _SECOND, _JOIN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
])


def _hash_of(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(words.split(data, np.array([0, len(data)]), words.ALNUM_LOWER).hash[0])


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each word; with size 2 the first has none before it."""
    if size == 1 or not len(h):
        return words.mix(h * _FIRST)
    out = np.empty_like(h)
    out[0] = 0
    out[1:] = words.mix(h[:-1] * _FIRST + h[1:] * _SECOND)
    return out


class Patterns:
    """Shift tables and buckets of the windows of some benchmark items."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            found = _WORD.findall((text or "").encode().lower())
            for i in range(max(1, len(found) - window + 1) if found else 0):
                owners.setdefault(tuple(found[i : i + window]), set()).add(item)
        hashes = {w: _hash_of(w) for pattern in owners for w in pattern}
        self.lengths = []
        for length in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == length]
            size = 2 if length > 1 else 1
            table = np.array([[hashes[w] for w in p] for p in own], np.uint64)
            flat = _blocks(table.reshape(-1), size).reshape(len(own), length)
            farthest = length - size + 1
            shift = np.full(1 << _SHIFT_BITS, farthest, np.uint8)
            for j in range(size - 1, length):
                at = (flat[:, j] >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)
                np.minimum.at(shift, at, np.uint8(length - 1 - j))
            both = words.mix(flat[:, length - 1] + flat[:, size - 1] * _JOIN)
            order = np.argsort(both, kind="stable")
            ids = [sorted(owners[own[k]]) for k in order]
            self.lengths.append({
                "length": length, "size": size, "shift": shift, "bucket": both[order], "hashes": table[order], "words": [b" ".join(own[k]) for k in order],
                "items": ids,
            })

    def search(self, data: np.ndarray, found: words.Words) -> tuple[np.ndarray, np.ndarray, list]:
        """First word, length and item names of every occurrence; windows stay inside one document."""
        none = np.zeros(0, np.int64)
        starts, sizes, names = [none], [none], []
        doc, n = found.doc, len(found.hash)
        for p in self.lengths:
            length, size = p["length"], p["size"]
            if n < length:
                continue
            block = _blocks(found.hash, size)
            code = (block >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)
            ends = self._stops(p["shift"], code, length, n)
            begins = ends - length + 1
            same = doc[begins] == doc[ends]
            ends, begins = ends[same], begins[same]
            both = words.mix(block[ends] + block[begins + size - 1] * _JOIN)
            left = np.searchsorted(p["bucket"], both, side="left")
            count = np.searchsorted(p["bucket"], both, side="right") - left
            at = np.repeat(begins, count)
            which = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            equal = np.ones(len(at), bool)
            for k in range(length):
                equal &= found.hash[at + k] == p["hashes"][which, k]
            at, which = at[equal], which[equal]
            true = np.array([self._words_at(data, found, i, length) == p["words"][w] for i, w in zip(at.tolist(), which.tolist(), strict=True)], bool)
            at, which = at[true], which[true]
            starts.append(at)
            sizes.append(np.full(len(at), length))
            names += [p["items"][w] for w in which.tolist()]
        return np.concatenate(starts), np.concatenate(sizes), names

    @staticmethod
    def _stops(shift: np.ndarray, code: np.ndarray, length: int, n: int) -> np.ndarray:
        """Words where some pattern could end: every lane moves on by the shift of the block at its place."""
        at = np.arange(length - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        out = [np.zeros(0, np.int64)]
        while len(at):
            step = shift[code[at]]
            out.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(out)

    @staticmethod
    def _words_at(data: np.ndarray, found: words.Words, first: int, length: int) -> bytes:
        return b" ".join(data[found.start[i] : found.end[i]].tobytes().lower() for i in range(first, first + length))


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of at most a few MB of text; only one is in memory at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).filter(F.col(text).isNotNull() & F.col(item).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, out: str = "decontamination", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Add the struct `out`: n_words, n_hit (words inside any occurrence of a window), items (names of the items with occurring
    windows, sorted as text) and spans (first and last word of each stretch of hit words).

    Words are those of the lower-cased (A-Z) text; an item with fewer words than a window is one window. Null or empty texts have no
    words and no hits; items without words or without a name match nothing. Repeated rows are judged alike. Very long texts are searched
    whole, as bytes. An empty table gives an empty one; an empty benchmark has no hits. The benchmark passes through the driver, which
    builds its tables, and is sent out in blocks of 8 MB, one scan step for each: it must fit the driver's memory. The documents are never shuffled.
    """
    spark = docs.sparkSession
    made = None
    for block in _item_blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(pickle.dumps(Patterns(block, window)))
        name = free_name(docs if made is None else made[0], out if made is None else f"{out}_more")
        made = (map_texts(docs if made is None else made[0], RESULT, _searcher(sent), name, text), [*(made[1] if made else []), name])
    if made is None:
        empty = map_texts(docs, RESULT, _searcher(None), out, text)
        made = (empty, [out])
    df, names = made
    merged = F.col(names[0])
    for other in names[1:]:  # several blocks: put the stretches together
        merged = _merged(merged, F.col(other))
    kept = [c for c in docs.columns if keep_text or c != text]
    return df.select(*[F.col(c) for c in kept], merged.alias(out))


def _merged(a, b):
    """Union of two results of the same text."""
    spans = F.array_sort(F.concat(a["spans"], b["spans"]))
    start = F.struct(F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("done"), F.lit(None).cast("struct<first:bigint,last:bigint>").alias("open"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def step(acc, x):
        joins = acc["open"].isNotNull() & (x["first"] <= acc["open"]["last"] + 1)
        grown = F.struct(acc["open"]["first"].alias("first"), F.greatest(acc["open"]["last"], x["last"]).alias("last"))
        closed = F.concat(F.coalesce(acc["done"], empty), F.when(acc["open"].isNull(), empty).otherwise(F.array(acc["open"])))
        return F.when(joins, F.struct(acc["done"].alias("done"), grown.alias("open"))).otherwise(F.struct(closed.alias("done"), x.alias("open")))

    joined = F.aggregate(spans, start, step, lambda acc: F.concat(F.coalesce(acc["done"], empty), F.when(acc["open"].isNull(), empty).otherwise(F.array(acc["open"]))))
    hit = F.aggregate(joined, F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    return F.struct(a["n_words"].alias("n_words"), hit.alias("n_hit"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"), joined.alias("spans"))


def _searcher(sent):
    def make():
        patterns = pickle.loads(sent.value) if sent is not None else Patterns([])

        def run(data: np.ndarray, at: np.ndarray) -> dict:
            found = words.split(data, at, words.ALNUM_LOWER)
            start, size, names = patterns.search(data, found)
            n, docs = len(found.hash), len(at) - 1
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size, -1)
            hit = np.cumsum(edge[:n]) > 0
            items: list[set[str]] = [set() for _ in range(docs)]
            for d, own in zip((np.searchsorted(found.first, start, side="right") - 1).tolist(), names, strict=True):
                items[d].update(own)
            spans: list[list[dict]] = [[] for _ in range(docs)]
            for d in [k for k in range(docs) if items[k]]:
                a, b = int(found.first[d]), int(found.first[d + 1])
                turns = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                spans[d] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(turns[::2], turns[1::2], strict=True)]
            return {"n_words": found.counts, "n_hit": words.per_document(hit, found.first), "items": [sorted(x) for x in items], "spans": spans}

        return run

    return make


def contaminated(result):
    """The rule: some word is hit, and at least one word of twenty."""
    return (result["n_hit"] > 0) & (20 * result["n_hit"] >= result["n_words"])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
