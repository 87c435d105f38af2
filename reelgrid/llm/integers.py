"""Vectors as whole numbers: rows with a missing or non-finite component go, the rest become packed integers."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import arrow_map

LIMIT = 1 << 27


def bound(width: int) -> int:
    """Largest magnitude for which no squared distance or inner product of that width leaves 64 bits."""
    return min(LIMIT, isqrt(((1 << 63) - 1) // max(width, 1)) // 2)


def packed(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, pa.Array]:
    """Positions of the rows kept, and ``floor(scale * x)`` of their components as little-endian int32."""
    there = np.flatnonzero(pc.is_valid(vectors).to_numpy(zero_copy_only=False))
    widths = pc.list_value_length(vectors).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(there)), widths)
    kept = np.bincount(owner[~np.isfinite(flat)], minlength=len(there)) == 0
    flat, widths = flat[kept[owner]], widths[kept]
    most = np.repeat(np.array([bound(w) for w in widths.tolist()], np.float64), widths)
    whole = np.clip(np.floor(flat * scale), -most, most).astype("<i4")
    ends = np.concatenate(([0], np.cumsum(widths) * 4)).astype(np.int64)
    made = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(widths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(whole.tobytes())]
    )
    return there[kept], pc.cast(made, pa.binary())


def integer_vectors(
    vectors: DataFrame, scale: int, id_column: str = "vec_id", column: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id bigint, label bigint, vec binary``; other columns are left out, whatever their names.

    ``vec`` holds ``floor(scale * x)`` per component as int32. Rows whose vector is null or holds null or
    non-finite components go; an empty vector stays, with no bytes. Components beyond ``bound(width)``
    (32,768 / 4,096ths for up to 128 components) stop there, so that later sums are exact in 64 bits.
    """
    own = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.col(label).cast("bigint").alias("label"),
        F.col(column).cast("array<double>").alias("v"),
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, vec = packed(batch.column("v"), scale)
        kept = batch.select(["vec_id", "label"]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*kept.columns, vec], ["vec_id", "label", "vec"])

    return arrow_map(own, work, "vec_id bigint, label bigint, vec binary")


def matrix(vecs: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors of that width, and their components as rows."""
    at = np.flatnonzero(pc.binary_length(vecs).to_numpy(zero_copy_only=False) == 4 * width)
    found = b"".join(vecs.take(pa.array(at)).to_pylist())
    return at, np.frombuffer(found, "<i4").reshape(len(at), width).astype(np.int64)
