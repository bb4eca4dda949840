"""Row-wise text operators as one Arrow pass: the result is one struct column beside the columns of the input."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trialkit.llm import words

#: (bytes, document offsets) of some documents -> a list or array for each field of the result, one entry per document
TextFunction = Callable[[np.ndarray, np.ndarray], dict]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: rows of one Arrow batch of a table with texts; the engine's default of 10,000 may be hundreds of MB of text
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold fewer rows, unless the session has a setting of its own. No result depends on it."""
    if spark.conf.get(_BATCH_SETTING, "10000") == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


_resident: dict[str, Callable[[], None]] = {}


def resident(name: str, free: Callable[[], None]) -> None:
    """Tell how to free what a Python worker keeps for later tasks of one kind."""
    _resident[name] = free


def begin_task(keeps: str = "") -> None:
    """Free what this worker keeps for other kinds of tasks."""
    for name, free in _resident.items():
        if name != keeps:
            free()


def end_task() -> None:
    """Hand free memory back to the system: workers live on, and other processes of the executor need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    docs: DataFrame, fields: T.StructType, make: Callable[[], TextFunction], out: str, text: str = "text", keep_text: bool = True,
    limit: int = words.SLICE_BYTES, keeps: str = "",
) -> DataFrame:
    """Add the struct column `out`. `make` runs once in each task and returns the function that works on slices of documents.

    Documents go through in slices of about 1 MB (`limit` bytes, or one document), so a batch with very long texts does not fill memory.
    """
    small_batches(docs.sparkSession)
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {out}; choose another name for the result")
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, fields)])
    struct = to_arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(keeps)
        fn = make()
        for batch in batches:
            data, at = words.buffers(batch.column(batch.schema.get_field_index(text)))
            for i, j in words.slices(at, limit):
                got = fn(data, at[i : j + 1])
                parts = [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=f.type) for f in struct]
                made = pa.StructArray.from_arrays(parts, fields=list(struct))
                same = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in kept]
                yield pa.RecordBatch.from_arrays([*same, made], names=[*kept, out])
        getattr(fn, "finish", lambda: None)()
        end_task()

    return docs.mapInArrow(run, schema)
