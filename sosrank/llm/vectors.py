"""Whole-number vectors: rows fit for use, and their packed form.

A vector travels as one binary value: its components as little-endian 16-bit integers, or, where one does not fit,
as 64-bit integers with one more byte at the end (which makes the length odd).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sosrank.llm.common import ship

SCALE = 256
NARROW, WIDE = np.dtype("<i2"), np.dtype("<i8")


def usable(vector: Column) -> Column:
    """True where the vector is not null and all its components are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double"))
                   | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def whole(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of every component, taken as double, as longs (saturated to their range)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as an int64 matrix; shorter rows are filled with zeros."""
    sizes = np.asarray(pc.list_value_length(column))
    flat = np.asarray(column.flatten())
    width = int(sizes.max(initial=0))
    if len(sizes) * width == len(flat):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def pack_rows(column: pa.Array) -> pa.Array:
    """A list column of longs as packed vectors."""
    sizes = np.asarray(pc.list_value_length(column))
    flat = np.asarray(column.flatten())
    if not len(flat) or (flat.min() >= -(1 << 15) and flat.max() < 1 << 15):
        ends = np.concatenate([[0], np.cumsum(sizes * 2)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [
            None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.astype(NARROW).tobytes())])
    out = []
    for row in np.split(flat, np.cumsum(sizes)[:-1]):
        fits = not len(row) or (row.min() >= -(1 << 15) and row.max() < 1 << 15)
        out.append(row.astype(NARROW).tobytes() if fits else row.astype(WIDE).tobytes() + b"w")
    return pa.array(out, pa.binary())


def unpack_rows(vectors: list[bytes]) -> np.ndarray:
    """Packed vectors as an integer matrix, 16 bits wide where all fit; shorter rows are filled with zeros."""
    sizes = {len(v) for v in vectors}
    if len(sizes) == 1 and not next(iter(sizes)) % 2:
        return np.frombuffer(b"".join(vectors), NARROW).reshape(len(vectors), -1)
    rows = [np.frombuffer(v[:-1], WIDE) if len(v) % 2 else np.frombuffer(v, NARROW) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def packed(rows: DataFrame, vector_col: str = "x") -> DataFrame:
    """``rows`` with the array of longs ``vector_col`` replaced by its packed form."""
    ship(rows.sparkSession)
    at = rows.columns.index(vector_col)

    def run(batches):
        for batch in batches:
            cols = batch.columns
            cols[at] = pack_rows(cols[at])
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    kinds = [f"`{f.name}` {'binary' if f.name == vector_col else f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join(kinds))
