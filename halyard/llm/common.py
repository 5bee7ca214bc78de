"""Helpers shared by the operators: bounded Arrow batches and slices of them, summed count vectors."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.storage import cut, cut_in_buckets, new_folder, remove, shared_dir, table  # noqa: F401

#: Bytes of text that one numpy step works on, so that a worker's memory doesn't follow the length of its Arrow batches.
SLICE_BYTES = 2 << 20


#: Bytes of rows that a Python task is sent at a time.
BATCH_BYTES = "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to send Arrow batches of BATCH_BYTES: their default is a count of rows, whose texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


@functools.cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives a worker's freed memory back to the system: workers stay between tasks, and what they keep counts."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about limit bytes of that string column each; a longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    a = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(a), 0), dtype=np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def summed(df: DataFrame, keys: list[str], value: str, dtype: str = "int64") -> DataFrame:
    """Adds up equal-length numeric vectors (their bytes) over each key; a task that fed it has sent one row a key and slice."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + f", {value} binary"

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(b.schema.get_field_index(value)):
                v = np.frombuffer(x.as_buffer(), dtype)
                total = v.copy() if total is None else np.add(total, v, out=total)
        names = [*keys, value]
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([total.tobytes()], pa.binary())], names=names)

    return df.select(*keys, value).groupBy(*keys).applyInArrow(add, schema)


def in_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, limit: int = SLICE_BYTES) -> Callable:
    """f over the slices of each batch, for mapInArrow."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, column, limit):
                out = f(s)
                if out is not None and out.num_rows:
                    yield out
            release()

    return over


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<start: int, kind: int, end: int>>"


def written(spans: str | F.Column, kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(spans: str, kind: int) -> F.Column:
    """The spans of that kind, as a long."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
