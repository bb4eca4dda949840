"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last of its encoding. An automaton over the vocabulary lists, while it
reads the bytes once, the tokens that end each prefix (those that are suffixes of it). The token is the last one if it covers the whole
prefix, or if it may follow the last token of the prefix before it. Two tokens may stand side by side if undoing their merges, latest
first, never meets a pair that a merge would have joined earlier. Back-pointers from the end give the ids. No merge is ever replayed, and
the work is linear in the text for a given vocabulary.

The vocabulary file is a parameter: a JSON of the tokenizers library with a BPE model and the byte-level pre-tokenizer and decoder.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trialkit.llm.frames import map_texts, resident

#: fixed value: how byte-level BPE cuts a text before its merges
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# fixed values: letters, digits and white space up to U+00FF; within them the standard library's patterns cut alike and take less than half the time
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
LATIN_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
CACHE_PIECES = 150_000
CACHE_PAIRS = 150_000
_NEVER = 1 << 60


def _letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _latin(text: str) -> bool:
    """True if no character is beyond U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def load(path: str) -> bytes:
    """Read a vocabulary file into what the encoder needs, packed for sending to tasks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or after.get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("needs a byte-level BPE vocabulary without a normalizer")
    if before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("this kind of byte-level vocabulary is not supported")
    byte_of = _letters()
    vocab = {t: bytes(byte_of[c] for c in t) for t in model["vocab"] if all(c in byte_of for c in t)}
    ids = model["vocab"]
    size = max([*ids.values(), *(a["id"] for a in spec.get("added_tokens", []))]) + 1
    tokens: list[bytes] = [b""] * size
    for t, raw in vocab.items():
        tokens[ids[t]] = raw
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[(ids[left], ids[right])] = (rank, ids[left + right])
    added = {}
    for a in spec.get("added_tokens", []):
        if a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized"):
            raise ValueError("added tokens that strip or match whole words are not supported")
        added[a["content"]] = a["id"]
        tokens[a["id"]] = a["content"].encode()
    return pickle.dumps((tokens, merges, added))


class _Known(dict):
    """Ids of pieces as packed 32-bit integers, found when first asked for. When full, it starts anew; what the last generation knew is
    taken over when it is met again, so frequent pieces stay."""

    def __init__(self, coder: Encoder):
        super().__init__()
        self.coder, self.last = coder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.last.pop(piece, None)
        if ids is None:
            ids = array("i", self.coder.piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.last = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes texts; caches the ids of pieces, within fixed bounds."""

    def __init__(self, packed: bytes):
        self.tokens, merges, self.added = pickle.loads(packed)
        size = len(self.tokens)
        self.length = [len(t) for t in self.tokens]
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge = {}
        for (a, b), (rank, made) in merges.items():
            self.merge[(a, b)] = rank
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        special = set(self.added.values())
        self.automaton = ahocorasick.Automaton()
        for i, raw in enumerate(self.tokens):
            if raw and i not in special and (len(raw) == 1 or self.rank[i] >= 0):
                self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces, self.latin = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known = _Known(self)
        self.pairs: dict[int, bool] = {}

    def rest(self) -> None:
        """Give back what only a running task needs; the worker that holds this may do other work next."""
        self.known.last = {}

    def may_follow(self, a: int, b: int) -> bool:
        """True if encoding the bytes of a and b leaves the border between them."""
        rank, x, y, above_x, above_y = self.rank, a, b, _NEVER, _NEVER
        while True:
            joined = self.merge.get((x, y))
            # of two places for one rule the left is merged first
            if joined is not None and joined < above_x and joined <= above_y:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                above_x, x = rank[x], self.right[x]
            else:
                above_y, y = rank[y], self.left[y]

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        last = [-1] * len(raw)
        length, pairs = self.length, self.pairs
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - length[token]
            if before < 0:
                last[end] = token
                continue
            previous = last[before]
            pair = previous << 32 | token
            fits = pairs.get(pair)
            if fits is None:
                if len(pairs) >= CACHE_PAIRS:
                    pairs.clear()
                fits = pairs[pair] = self.may_follow(previous, token)
            if fits:
                last[end] = token
        ids, at = [], len(raw) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return tuple(ids)

    def _pieces(self, text: str) -> Iterable[str]:
        pattern = self.latin if _latin(text) else self.pieces
        if len(text) < 1 << 20:
            return pattern.findall(text)
        return (m[0] for m in pattern.finditer(text))  # no list of all pieces of a very long text

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens get their own ids."""
        out = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(array("i", [self.added[part]]).tobytes())
            else:
                pieces = iter(self._pieces(part))
                while some := b"".join(map(self.known.__getitem__, islice(pieces, 1 << 16))):
                    out.append(some)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", errors="replace")


_encoders: dict[str, Encoder] = {}


def encoder(packed: bytes) -> Encoder:
    """The encoder of a packed vocabulary; one for each Python worker, with its caches."""
    name = hashlib.sha256(packed).hexdigest()
    if name not in _encoders:
        resident("bpe", _encoders.clear)
        _encoders.clear()
        _encoders[name] = Encoder(packed)
    return _encoders[name]


def send(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load(path))


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, path: str, out: str = "bpe", text: str = "text", keep_text: bool = True, decoded: bool = False) -> DataFrame:
    """Add the struct `out` with ids, and with `decoded` also the text that the ids decode to.

    Whole texts are encoded, in one pass without a shuffle; null is an empty text, and an empty text has no ids. Repeated rows get
    equal ids. Very long texts are cut into pieces as they are read; a single piece costs memory in proportion to its bytes.
    An empty table gives an empty one.
    """
    sent = send(docs.sparkSession, path)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded

    def make():
        coder = encoder(sent.value)

        def run(data: np.ndarray, at: np.ndarray) -> dict:
            texts = [data[a:b].tobytes().decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            rows = [coder.encode(t) for t in texts]
            return {"ids": lists(rows)} | ({"decoded": [coder.decode(r) for r in rows]} if decoded else {})

        run.finish = coder.rest
        return run

    return map_texts(docs, T.StructType(fields), make, out, text, keep_text, keeps="bpe")


def decode(df: DataFrame, path: str, ids: str, out: str = "decoded") -> DataFrame:
    """Add the text that the ids of each row decode to. Null ids are no ids, which decode to an empty text."""
    sent = send(df.sparkSession, path)
    schema = T.StructType([*df.schema, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent.value)
        for batch in batches:
            texts = [coder.decode(r.values.to_numpy() if r.values is not None else []) for r in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
