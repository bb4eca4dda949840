"""Exact similarity join of word-shingle sets by parity sketches.

Every shingle of a document is hashed and flips one bit of a small parity sketch; it is also XORed into one word of a wider sketch of 64-bit
words. A shingle that only one of two documents has changes at most one bit and at most one word, so in either sketch the Hamming
distance is at most the size of the symmetric difference. Similarity of at least num/den bounds that size by
D = (a + b) * (den - num) / (den + num).

Search: documents are dealt into bands of doubling set size, and emit keys for their own band and, if larger partners can lie there, for the
next. All documents of a band use the same number of words. At most D words of linked documents differ, so, with the words in any common
order, their first equal word is among the first D + 1 of both. Shingles that are common (those of shared passages) go to words of
their own, and the order puts these last, before words without any shingle; otherwise words made of many shingles come first, as few
documents share those. Which shingles count as common changes the work only, never the result. Keys meet in packed form; pairs are then held against the small parity sketches and the
rest is verified on the whole sets. Keys that many texts share are not expanded: their texts are compared with three of them first, and
only if the links found do not join them all, block by block among those still apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm import words
from trialkit.llm.components import components
from trialkit.llm.frames import begin_task, end_task, map_texts
from trialkit.session import broadcast_if_small, cut

SMALL_GROUP = 8
COMPARE_BLOCK = 256
KEYS_PER_BUCKET = 250_000
KEYS_PER_TASK = 500_000
FLUSH_KEYS = 250_000
COMMON_LIMIT = 1_000_000
COMMON_SLICE = 4 << 20
_SPREAD = 1.6
_LEAST_WORDS = 32
_U = np.uint64


def _salt(x: int) -> np.uint64:
    return _U(x * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


class Similarity:
    """The threshold num/den and the bounds that follow from it."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den

    def difference(self, a, b):
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, n):
        return n * self.den // self.num

    def linked(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """(band, words of its sketch, keys to emit) for a set of n."""
        own, most, out = n.bit_length(), self.largest(n), []
        band = own
        while band == own or (1 << band - 1) <= most:
            top = (1 << band) - 1
            size = max(_LEAST_WORDS, int(_SPREAD * (self.difference(top, top) + 1)) + 1)
            out.append((band, size, int(self.difference(n, min(top, most))) + 1))
            band += 1
        return out


def shingles(found: words.Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; with fewer words than a shingle all words make one."""
    h, at = words.windows(found, size)
    cut_at = np.searchsorted(at, found.first)
    out = []
    for d, n in enumerate(found.counts.tolist()):
        if n >= size:
            out.append(np.unique(h[cut_at[d] : cut_at[d + 1]]))
        elif n:
            own = found.hash[found.first[d] : found.first[d + 1]]
            out.append(words.mix(np.array([np.bitwise_xor.reduce(words.mix(own + words.mix(np.arange(n, dtype=np.uint64) + _salt(n))))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one, two = words.mix(s + _salt(3)).sum(dtype=np.uint64), words.mix(s ^ _salt(5)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def parity(s: np.ndarray) -> bytes:
    """One bit for each residue of the hashes, set if an odd number of shingles has it; one to two bits for each shingle."""
    bits = max(64, 1 << int(len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, n: int) -> np.ndarray:
    """The sketch of the same sets with fewer bits (n words of 64)."""
    while sketch.shape[-1] > n:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(fold(a, n) ^ fold(b, n)).sum(-1, dtype=np.int64)


def keys(s: np.ndarray, law: Similarity, common: np.ndarray) -> np.ndarray:
    """Search keys of a set: of each of its bands the first D + 1 words of the sketch in the common order."""
    out = []
    often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    kinds = [(0, s[~often]), (1, s[often])]
    for band, size, need in law.bands(len(s)):
        places, values, left = [], [], need
        for kind, own in kinds:
            if not left or not len(own):
                continue
            block = ((own >> _U(32)) * _U(size)) >> _U(32)  # ascending, as the hashes are
            begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            count = np.diff(np.concatenate([begin, [len(own)]]))
            first = np.argsort(-count, kind="stable")[:left]
            places.append(block[begin[first]] * _U(2) + _U(kind) + count[first].astype(np.uint64) * _salt(11))
            values.append(np.bitwise_xor.reduceat(words.mix(own + _salt(7)), begin)[first])
            left -= len(first)
        for kind, own in kinds:  # words without shingles, in order
            if left:
                empty = np.setdiff1d(np.arange(size, dtype=np.uint64), ((own >> _U(32)) * _U(size)) >> _U(32))[:left]
                places.append(empty * _U(2) + _U(kind))
                values.append(np.zeros(len(empty), np.uint64))
                left -= len(empty)
        out.append(words.mix(np.concatenate(values) ^ words.mix(np.concatenate(places) + _salt(band + 13))))
    return np.concatenate(out)


SIGNATURE = T.StructType([T.StructField("n", T.LongType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("common", T.BinaryType())])


def _signatures(size: int, codes: np.ndarray):
    def make():
        def run(data: np.ndarray, at: np.ndarray) -> dict:
            sets = shingles(words.split(data, at, codes), size)
            ids = [identity(s) for s in sets]
            every, times = np.unique(np.concatenate(list(dict(zip(ids, sets, strict=True)).values())), return_counts=True)
            common = [every[times > 1].tobytes()] + [None] * (len(sets) - 1)
            return {"n": [len(s) for s in sets], "one": [i[0] for i in ids], "two": [i[1] for i in ids], "sketch": [parity(s) if len(s) else b"" for s in sets], "common": common}

        return run

    return make


def _common(slices: DataFrame) -> np.ndarray:
    """Shingles that different texts of one slice share, in at least three slices and 3 % of all; the most frequent million at most (8 MB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(packed.as_buffer(), np.int64))], names=["shingle"])
        end_task()

    least = max(3, 0.03 * slices.count())
    often = slices.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= least)
    top = often.orderBy(F.col("count").desc(), "shingle").limit(COMMON_LIMIT).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def _emit_keys(docs: DataFrame, text: str, size: int, codes: np.ndarray, law: Similarity, bits: int, common: np.ndarray, local: int) -> DataFrame:
    """(bucket, keys, texts, marks, much): packed search keys, the texts that have them and the marks of these. A copy of a text met before in the same run adds nothing.

    The mark of a text says which of its keys is the least in an order that all texts share. Texts with equal marks share that key, so they are paired there
    and nowhere else: how often a pair is sent does not follow the number of keys that it shares.

    A key that more than `local` texts of one run share stands in a row of its own, with `much` the key and all its texts; only its leading
    texts are packed with the others. So what meets in one task for a key of very many texts is a few of each run.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        common = sent.value
        held, owners, marked, n, seen = [], [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not n:
                return
            k, who, mark = np.concatenate(held), np.concatenate(owners), np.concatenate(marked)
            order = np.argsort(k, kind="stable")
            k, who, mark = k[order], who[order], mark[order]
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.concatenate([begin, [len(k)]]))
            stays = np.ones(len(k), bool)
            for b, g in zip(begin[size > local].tolist(), size[size > local].tolist(), strict=True):
                members = who[b : b + g]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(k[b] >> _U(64 - bits))], pa.int64()), pa.nulls(1, pa.binary()), pa.array([members.tobytes()], pa.binary()), pa.array([_six(mark[b : b + g]).tobytes()], pa.binary()), pa.array(_short(k[b : b + 1], bits).view(np.int64))],
                    names=["bucket", "keys", "texts", "marks", "much"],
                )
                stays[b : b + g] = np.isin(members, _leaders(members))
            k, who, mark = k[stays], who[stays], _six(mark[stays])
            bucket = (k >> _U(64 - bits)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(k)]])
            low = _six(k)
            for lo in range(0, len(cuts) - 1, 64):  # a few MB at a time
                runs = [(int(x), int(y)) for x, y in zip(cuts[lo : lo + 64], cuts[lo + 1 : lo + 65], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[x]) for x, _ in runs], pa.int64()), pa.array([low[x:y].tobytes() for x, y in runs], pa.binary()), pa.array([who[x:y].tobytes() for x, y in runs], pa.binary()), pa.array([mark[x:y].tobytes() for x, y in runs], pa.binary()), pa.nulls(len(runs), pa.int64())],
                    names=["bucket", "keys", "texts", "marks", "much"],
                )

        for batch in batches:
            data, at = words.buffers(batch.column(0))
            for i, j in words.slices(at):
                for s in shingles(words.split(data, at[i : j + 1], codes), size):
                    if len(s) and (who := identity(s)) not in seen:
                        seen.add(who)
                        k = keys(s, law, common)
                        held.append(k)
                        owners.append(np.full(len(k), who[0], np.int64))
                        marked.append(np.full(len(k), _mark(_short(k, bits)).min()))
                        n += len(k)
                if n >= FLUSH_KEYS:
                    yield from flush()
                    held, owners, marked, n, seen = [], [], [], 0, set()
        yield from flush()
        held, owners, marked, seen = [], [], [], set()
        end_task()

    return docs.select(text).mapInArrow(run, "bucket long, keys binary, texts binary, marks binary, much long")


def _short(k: np.ndarray, bits: int) -> np.ndarray:
    """A key as it is after packing: its low 48 bits and the last 16 of its bucket."""
    return k & _U((1 << 48) - 1) | (k >> _U(64 - bits) & _U(0xFFFF)) << _U(48)


def _mark(k: np.ndarray) -> np.ndarray:
    """The place of a packed key in the order by which a text's least key is found (48 bits)."""
    return words.mix(k + _salt(29)) >> _U(16)


def _six(values: np.ndarray) -> np.ndarray:
    """The low six bytes of each number, one number per row."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6]


def _whole(packed: pa.Scalar) -> np.ndarray:
    """Numbers from their low six bytes."""
    low = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, 6)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :6] = low
    return full.view(np.uint64)[:, 0]


def _leaders(members: np.ndarray) -> np.ndarray:
    """Three of the texts, the least in three orders that all keys share."""
    return np.unique([members[np.argmin(words.mix(members.view(np.uint64) + _salt(salt)))] for salt in (17, 19, 23)])


def _star(members: np.ndarray, mark: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Pairs of each text with the leaders; those with equal marks only where that is the least key of both."""
    lead = np.flatnonzero(np.isin(members, _leaders(members)))
    x, y = np.repeat(np.arange(len(members)), len(lead)), np.tile(lead, len(members))
    here = (members[x] != members[y]) & ((mark[x] != mark[y]) | least[x])
    return np.sort(np.stack([members[x[here]], members[y[here]]], axis=1), axis=1)


def _meet(packed: DataFrame, tasks: int, bits: int, small: int) -> DataFrame:
    """Pairs (a, b) of texts that share a key, and the members of keys (gid) that more than a few texts share, or more than `local` of one run.

    Texts with equal marks are paired at the key of the mark only. At a key that many share the texts are paired with its leaders.
    """
    schema = "a long, b long, gid long, members binary"

    def pairs_of(k: np.ndarray, who: np.ndarray, mark: np.ndarray, apart: set[int]) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
        if len(k) < 2:
            return np.zeros((0, 2), np.int64), []
        order = np.argsort(k)
        k, who, mark = k[order], who[order], mark[order]
        equal = k[1:] == k[:-1]
        shared = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        k, who, mark = k[shared], who[shared], mark[shared]
        order = np.lexsort((who, k))
        k, who, mark = k[order], who[order], mark[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (who[1:] != who[:-1])]) if len(k) else np.zeros(0, bool)
        k, who, mark = k[new], who[new], mark[new]
        least = _mark(k) == mark
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([begin, [len(k)]]))
        found, large = [np.zeros((0, 2), np.int64)], {}
        for g in range(2, small + 1):
            at = begin[size == g][:, None] + np.arange(g)
            for x, y in combinations(range(g), 2):
                here = (mark[at[:, x]] != mark[at[:, y]]) | least[at[:, x]]
                found.append(who[at[here][:, [x, y]]])
        whole = (size > small) | np.isin(k[begin].view(np.int64), np.fromiter(apart, np.int64, len(apart)))  # the rest of a key in `apart` is not here
        for b, g in zip(begin[whole].tolist(), size[whole].tolist(), strict=True):
            members = who[b : b + g]
            gid = int(k[b].view(np.int64))
            large.setdefault((members.tobytes(), gid if gid in apart else None), gid)  # one key stands for all with the same texts
            found.append(_star(members, mark[b : b + g], least[b : b + g]))
            if len(found) > 512:
                found = [np.unique(np.concatenate(found), axis=0)]
        return np.unique(np.concatenate(found), axis=0), [(g, m) for (m, _), g in large.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_k, parts_w, parts_m, apart = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], set()
        for batch in batches:
            for bucket, packed_keys, who, mark, much in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in (1, 2, 3)], batch.column(4).to_pylist(), strict=True):
                if much is not None:
                    apart.add(much)
                    marks = _whole(mark)
                    least = marks == _mark(np.array([much]).view(np.uint64))
                    yield rows_of(_star(np.frombuffer(who.as_buffer(), np.int64), marks, least), [(much, who.as_py())])
                    continue
                parts_k.append(_whole(packed_keys) | _U((bucket & 0xFFFF) << 48))
                parts_w.append(np.frombuffer(who.as_buffer(), np.int64).copy())
                parts_m.append(_whole(mark))
        pairs, large = pairs_of(np.concatenate(parts_k), np.concatenate(parts_w), np.concatenate(parts_m), apart)
        for lo in range(0, len(pairs), 100_000):
            yield rows_of(pairs[lo : lo + 100_000], [])
        for lo in range(0, len(large), 50):
            yield rows_of(pairs[:0], large[lo : lo + 50])
        parts_k, parts_w, parts_m, pairs, large = [], [], [], None, []
        end_task()

    def rows_of(pairs: np.ndarray, groups: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(groups)
        sides = [pa.concat_arrays([pa.array(pairs[:, i], pa.int64()), pa.nulls(n, pa.int64())]) for i in (0, 1)]
        gid = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array([g for g, _ in groups], pa.int64())])
        own = pa.concat_arrays([pa.nulls(len(pairs), pa.binary()), pa.array([m for _, m in groups], pa.binary())])
        return pa.RecordBatch.from_arrays([*sides, gid, own], names=["a", "b", "gid", "members"])

    return packed.repartition(tasks, "bucket").mapInArrow(run, schema)


def _near(pairs: DataFrame, classes: DataFrame, law: Similarity, by: str) -> DataFrame:
    """Pairs of classes (a, b) whose sizes and parity sketches allow a link; the sides of the input are values of the column `by`."""
    left = classes.select(F.col(by).alias("a"), F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    right = classes.select(F.col(by).alias("b"), F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    wide = pairs.join(left, "a").join(right, "b").select("x", "y", "nx", "ny", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = (np.maximum(nx, ny) <= law.largest(np.minimum(nx, ny))) & (nx > 0)
            most = law.difference(nx, ny)
            for i in np.flatnonzero(ok).tolist():
                ok[i] = distance(np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)) <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])
        end_task()

    return wide.mapInArrow(run, "a long, b long").filter("a <> b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, codes: np.ndarray, law: Similarity) -> DataFrame:
    """The pairs that are linked, by the whole sets of both; sets are made again from the texts of the classes in question only."""
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    needed = cut(needed.join(classes.select("cid", "one", "two", "row"), "cid"))
    rows = needed.select("row").distinct()
    picked = docs.select(F.xxhash64(key).alias("row"), F.col(text).alias("body")).join(broadcast_if_small(rows, needed.count(), 48), "row", "left_semi")
    fields = T.StructType([T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("members", T.BinaryType())])

    def make():
        def run(data: np.ndarray, at: np.ndarray) -> dict:
            sets = shingles(words.split(data, at, codes), size)
            ids = [identity(s) for s in sets]
            return {"one": [i[0] for i in ids], "two": [i[1] for i in ids], "members": [s.tobytes() for s in sets]}

        return run

    made = map_texts(picked, fields, make, "set", "body", keep_text=False).select("set.*")
    sets = made.join(needed.select("one", "two", "cid"), ["one", "two"]).groupBy("cid").agg(F.first("members").alias("members"))
    sets = cut(sets)
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b").join(sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s, t = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                ok[i] = law.linked(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])
        end_task()

    return both.select("a", "b", "mb", "ma").mapInArrow(verify, "a long, b long")


def _apart(members: DataFrame, classes: DataFrame, labels: DataFrame, law: Similarity) -> DataFrame:
    """Pairs worth verifying among the texts of much-shared keys that the links found so far leave in different components.

    Keys with the same most frequent component are put together, as copies of one text share many keys; so a pair is met once and not for
    every key. In such a group the texts of other components are held against all by size and sketch. Groups beyond a few hundred texts
    are dealt into blocks of a bounded number of rows.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(packed.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), gid)), pa.array(own)], names=["gid", "one"])
        end_task()

    def pairs_of(left: tuple, right: tuple) -> np.ndarray:
        """Pairs of two lists of (cid, label, n, sketch) that differ in the label and may be linked."""
        ids, label, n, sketches = right
        by_width: dict[int, list[int]] = {}
        for i, x in enumerate(sketches):
            by_width.setdefault(len(x), []).append(i)
        stacked = [(np.array(at), np.stack([np.frombuffer(sketches[i], np.uint64) for i in at])) for at in by_width.values()]
        out = [np.zeros((0, 2), np.int64)]
        for x, own_label, m, sketch in zip(*left, strict=True):
            own = np.frombuffer(sketch, np.uint64)
            for at, wide in stacked:
                ok = (label[at] != own_label) & (np.maximum(n[at], m) <= law.largest(np.minimum(n[at], m)))
                if ok.any():
                    near = at[ok][distance(own, wide[ok]) <= law.difference(m, n[at[ok]])]
                    out.append(np.stack([np.minimum(ids[near], x), np.maximum(ids[near], x)], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lead, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = (*[one.values.field(i).to_numpy() for i in range(3)], one.values.field(3).to_pylist())
                other = np.flatnonzero(rows[1] != lead)
                pairs = pairs_of((*[r[other] for r in rows[:3]], [rows[3][i] for i in other.tolist()]), rows)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        end_task()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [tuple(own[c].to_numpy() for c in ("cid", "label", "n")) + (own["sketch"].tolist(),) for own in (pdf[pdf["side"] == 1], pdf[pdf["side"] == 0])]
        return pd.DataFrame(pairs_of(*sides), columns=["a", "b"])

    rows = members.mapInArrow(unpack, "gid long, one long").distinct().join(classes.select("one", "cid"), "one")
    rows = cut(rows.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("gid", "cid", F.coalesce("label", "cid").alias("label")))
    counted = rows.groupBy("gid", "label").count().groupBy("gid").agg(F.max_by("label", F.struct("count", "label")).alias("lead"), F.count(F.lit(1)).alias("labels"))
    leads = cut(counted.filter("labels > 1").select("gid", "lead"))
    groups = cut(rows.join(broadcast_if_small(leads, leads.count(), 48), "gid").select("lead", "cid", "label").distinct())
    sizes = cut(groups.groupBy("lead").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("label") != F.col("lead")).alias("others")))
    full = groups.join(classes.select("cid", "n", "sketch"), "cid").join(broadcast_if_small(sizes, sizes.count(), 48), "lead")
    own = F.collect_list(F.struct("cid", "label", "n", "sketch")).alias("own")
    pairs = full.filter(F.col("size") <= COMPARE_BLOCK).groupBy("lead").agg(own).mapInArrow(within, "a long, b long")
    if sizes.filter(F.col("size") > COMPARE_BLOCK).limit(1).count():
        large = full.filter(F.col("size") > COMPARE_BLOCK)
        blocks, chunks = F.ceil(F.col("size") / COMPARE_BLOCK), F.ceil(F.col("others") / COMPARE_BLOCK)
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        block, chunk = F.pmod(F.xxhash64("cid"), blocks), F.pmod(F.xxhash64("cid", F.lit(1)), chunks)
        every = large.withColumn("block", block).withColumn("chunk", upto(chunks)).withColumn("side", F.lit(0))
        others = large.filter("label <> lead").withColumn("block", upto(blocks)).withColumn("chunk", chunk).withColumn("side", F.lit(1))
        pairs = pairs.union(every.unionByName(others).groupBy("lead", "block", "chunk").applyInPandas(compare, "a long, b long"))
    return pairs.filter("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 75, den: int = 100,
    codes: np.ndarray = words.BLANKS_LOWER, small: int = SMALL_GROUP, keep: Sequence[str] = (), group: str | None = None,
) -> DataFrame:
    """(key, columns of `keep`, n_shingles, component_id) of every row: the size of the set of distinct word shingles, and the smallest key that
    links of similarity num/den or more reach, the row itself included.

    Words are those between ASCII blanks, with A-Z lower-cased. Texts with fewer words than a shingle have one shingle of all their words; null
    texts and texts without words have an empty set and link with nothing, not even each other. Equal sets are one class from the first
    step on, however many copies there are. A null key never names a component unless all its members have none. Repeated rows
    come out as often as they came in. Long texts are read whole. No rows in, no rows out. Where a key stands on several texts, one component_id may name
    several components; the column `group`, if asked for, has a number of its own for each (null for empty sets).
    """
    law = Similarity(num, den)
    docs = docs.select(key, *keep, text)
    signed = map_texts(docs, SIGNATURE, _signatures(shingle, codes), "__s", text, keep_text=False, limit=COMMON_SLICE)
    signed = cut(signed.select(key, *keep, "__s.*"))
    common = _common(signed.filter("common IS NOT NULL").select("common"))
    grouped = signed.filter("n > 0").groupBy("one", "two").agg(F.min(key).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("row", F.xxhash64("first")))
    total = (classes.agg(F.sum("n")).first()[0] or 0) // 2
    bits = max(6, int(total // KEYS_PER_BUCKET).bit_length())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // KEYS_PER_TASK))
    met = cut(_meet(_emit_keys(docs, text, shingle, codes, law, bits, common, 4 * small), tasks, bits, small))
    near = cut(_near(met.filter("members IS NULL").select("a", "b").distinct(), classes, law, "one"))
    links = cut(_verified(near, classes, docs, key, text, shingle, codes, law))
    labels = components(links)
    more = cut(_apart(met.filter("members IS NOT NULL").select("gid", "members"), classes, labels, law))
    if more.limit(1).count():
        links = cut(links.union(_verified(more, classes, docs, key, text, shingle, codes, law)))
        labels = components(links)
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid")
    smallest = named.groupBy("label").agg(F.min("first").alias("smallest"))
    joined = named.join(smallest, "label").select("cid", "smallest", "label")
    number = [] if group is None else [F.coalesce("label", "cid").alias(group)]
    final = classes.join(joined, "cid", "left").select("one", "two", F.coalesce("smallest", "first").alias("component_id"), *number)
    return signed.join(final, ["one", "two"], "left").select(
        key, *keep, *([] if group is None else [group]), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"),
    )
