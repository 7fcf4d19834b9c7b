"""Vectors in double precision, hashes and bit distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def mean_absolute_error(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def centred(a: Column, floor: float = 1e-8) -> Column:
    """Less its mean and of unit length; a constant vector becomes zeros."""
    mean = _sum(a) / F.size(a)
    c = F.transform(a, lambda x: x - mean)
    n = F.greatest(F.sqrt(dot(c, c)), F.lit(floor))
    return F.transform(c, lambda x: x / n)


def correlation(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Pearson's, 0 where a side is constant. By sums over each array once: what a lambda refers to is worked out for every element."""
    n = F.size(a)
    spread = lambda x: F.sqrt(F.greatest(dot(x, x) - _sum(x) * _sum(x) / n, F.lit(0.0)))
    left, right = spread(a), spread(b)
    return F.when((left <= floor) | (right <= floor), 0.0).otherwise((dot(a, b) - _sum(a) * _sum(b) / n) / (left * right))


def pearson(a: Column, b: Column) -> Column:
    """Pearson's correlation, NaN where a side is constant."""
    n = F.size(a)
    square = lambda x: dot(x, x) - _sum(x) * _sum(x) / n
    flat = lambda x: F.array_min(x) == F.array_max(x)
    return F.when(flat(a) | flat(b), F.lit(float("nan"))).otherwise((dot(a, b) - _sum(a) * _sum(b) / n) / F.sqrt(square(a) * square(b)))


def difference_hash(a: Column, rows: int = 8, width: int = 9) -> Column:
    """Bits of left < right in a row-major grid of rows x width values, first comparison in the highest bit."""
    pairs = F.array(*[F.when(F.get(a, r * width + c) < F.get(a, r * width + c + 1), 1).otherwise(0).cast("bigint") for r in range(rows) for c in range(width - 1)])
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def differs(a: Column, b: Column, tolerance: float) -> Column:
    """abs(a - b) > tolerance, never for NaN."""
    d = F.abs(a - b)
    return ~F.isnan(d) & (d > tolerance)


def dense(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes, valid) of a column of vectors: a row each, zeros beyond its size; one that is null or holds a null is not valid and all zeros."""
    flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    width = int(sizes.max(initial=0))
    if not column.null_count and not flat.null_count and len(flat) == width * len(column):
        return flat.to_numpy().reshape(len(column), width), sizes, np.ones(len(column), bool)
    rows = column.to_pylist()
    valid = np.array([r is not None and None not in r for r in rows], bool)
    v = np.array([(r + [0.0] * (width - len(r))) if ok else [0.0] * width for r, ok in zip(rows, valid, strict=True)], float)
    return v.reshape(len(column), width), sizes, valid
