"""Token counts of fields and sections from one encoding of the whole document.

Fields are put together to one text, which is encoded once. Every token covers a range of bytes; these ranges are joined with
the ranges of the sections (both in order, by binary search). A token inside one section belongs to it. A token that crosses a
border goes by a stated rule: `most`: to the section that holds most of its bytes, the earlier one on a tie; `first`: to the section of
its first byte. Tokens that touch no section count as outside. So the counts of all sections and the outside add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trialkit.llm import bpe, words
from trialkit.llm.frames import end_task, small_batches

PART = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("n_crossing", T.LongType()),
])
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_outside", T.LongType()), T.StructField("parts", T.ArrayType(PART))])
RULES = ("most", "first")


def allocate(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: outside), and whether the token reaches beyond one section. Sections are in order and apart; empty ones get nothing."""
    owner, crossing = np.full(len(token_start), -1), np.zeros(len(token_start), bool)
    held = np.flatnonzero(end > start)
    start, end = start[held], end[held]
    if not len(start) or not len(token_start):
        return owner, crossing
    low, high = np.searchsorted(end, token_start, side="right"), np.searchsorted(start, token_end, side="left")
    touching = np.flatnonzero(high > low)
    k = low[touching]
    inside = (start[k] <= token_start[touching]) & (token_end[touching] <= end[k])
    owner[touching[inside]] = held[k[inside]]
    across = touching[~inside]
    crossing[across] = True
    if rule == "first":
        k = low[across]
        first = start[k] <= token_start[across]
        owner[across[first]] = held[k[first]]
        return owner, crossing
    best = np.zeros(len(across), np.int64)
    for step in range(int((high[across] - low[across]).max()) if len(across) else 0):
        k = np.minimum(low[across] + step, len(start) - 1)
        share = np.where(low[across] + step < high[across], np.minimum(token_end[across], end[k]) - np.maximum(token_start[across], start[k]), 0)
        more = share > best
        best[more], owner[across[more]] = share[more], held[k[more]]
    return owner, crossing


def attribute(docs: DataFrame, path: str, fields: Sequence[str], by_line: Sequence[str] = (), out: str = "tokens", rule: str = "most", glue: str = " ") -> DataFrame:
    """Add the struct `out`: n_tokens of the whole document, n_outside, and for each part its field, number, bytes, tokens and how many of them cross its border.

    The document is the fields in order with `glue` between; a null field is empty. A field of `by_line` is one part per line, without the
    line ends; other fields are one part. Empty parts have no tokens. Repeated rows get equal counts. Whole documents are encoded, in one
    pass without a shuffle; a very long one costs memory in proportion to its bytes. An empty table gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {out}; choose another name for the result")
    small_batches(docs.sparkSession)
    sent, names, split = bpe.send(docs.sparkSession, path), list(docs.columns), [f in by_line for f in fields]
    schema = T.StructType([*docs.schema, T.StructField(out, RESULT)])
    kind = to_arrow_type(RESULT)
    wide = docs.select("*", F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("__fields"))

    def sections(values: list[str]) -> tuple[str, list[tuple[str, int]], np.ndarray, np.ndarray]:
        names_of, start, end, at = [], [], [], 0
        for f, (name, value) in enumerate(zip(fields, values, strict=True)):
            for k, piece in enumerate(value.split("\n") if split[f] else [value]):
                size = len(piece.encode())
                names_of.append((name, k))
                start.append(at)
                end.append(at + size)
                at += size + 1
            at += len(glue.encode()) - 1
        return glue.join(values), names_of, np.array(start), np.array(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(sent.value)
        length = np.array(coder.length)
        for batch in batches:
            column = batch.column(len(names))
            size = np.array([sum(map(len, v)) for v in column.to_pylist()]) if batch.num_rows else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            for i, j in words.slices(at):
                rows = []
                for values in column.slice(i, j - i).to_pylist():
                    text, names_of, start, end = sections(values)
                    ids = coder.encode(text)
                    stop = np.cumsum(length[ids])
                    owner, crossing = allocate(stop - length[ids], stop, start, end, rule)
                    own = owner >= 0
                    n, x = np.bincount(owner[own], minlength=len(start)), np.bincount(owner[own & crossing], minlength=len(start))
                    parts = [
                        {"field": f, "part": k, "n_bytes": b, "n_tokens": t, "n_crossing": c}
                        for (f, k), b, t, c in zip(names_of, (end - start).tolist(), n.tolist(), x.tolist(), strict=True)
                    ]
                    rows.append({"n_tokens": len(ids), "n_outside": int((~own).sum()), "parts": parts})
                kept = [batch.column(c).slice(i, j - i) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, kind)], names=[*names, out])
        coder.rest()
        end_task()

    return wide.mapInArrow(run, schema)
