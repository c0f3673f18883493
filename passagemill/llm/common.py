"""Helpers that the operators of this package share.

Operators read only the columns they name; other columns of an input, whatever they
are called, are ignored.  Work inside tasks goes over slices of bounded bytes, so the
memory of a task does not depend on how Spark batches its rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators.topk import cut_lineage, scratch_path

__all__ = ["crc_fold", "cut_lineage", "mix64", "read", "scratch_path", "slices", "text_bytes", "to_list_array"]

#: Bytes of text that a task works on at a time (a longer single text is a slice of its own).
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_fold(id_column: str, folds: int, fold: int) -> Column:
    """Whether the row belongs to the given fold of crc32 of the id as text (null ids do not)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``most`` bytes in ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def text_bytes(array: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null gives no bytes."""
    return [b"" if v is None else v for v in array.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def to_list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths, cut one after the other from ``values``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
