"""Vectors of an Arrow batch as matrices, and their bit planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Integer components must stay below this size, so that sums of products of 64 of them fit 64 bits.
LIMIT = 1 << 27


def scaled_rows(vectors: pa.Array, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component as integers, zero beyond a shorter vector's end, and which rows take part.

    Null vectors and vectors with a null or non-finite component take no part. Larger components than LIMIT fail.
    """
    lengths = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    row = np.repeat(np.arange(len(vectors)), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ok = ~np.asarray(vectors.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    finite = np.isfinite(values)
    ok[row[~finite]] = False
    scaled = np.floor(scale * np.where(finite, values, 0.0))
    if np.abs(scaled[ok[row]]).max(initial=0) >= LIMIT:
        raise ValueError(f"a scaled component lies beyond {LIMIT}: its products would not fit 64 bits")
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    fits = (column < dims) & ok[row]
    out[row[fits], column[fits]] = scaled[fits].astype(np.int64)
    return out, ok


def bit_planes(rows: np.ndarray, count: int) -> np.ndarray:
    """Planes of whole numbers in two's complement: bit d of word w of plane i is bit i of component 64 w + d.

    The number of columns is a multiple of 64; the result has the shape (rows, planes, words).
    """
    n, dims = rows.shape
    out = np.empty((n, count, dims // 64), dtype=np.uint64)
    for i in range(count):
        out[:, i] = np.packbits((rows >> i & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def unpacked(values: pa.Array, kind: str) -> np.ndarray:
    """The matrix whose rows a column of equally long binary values holds."""
    data = values.to_pylist()
    return np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1) if data else np.empty((0, 0), dtype=kind)
