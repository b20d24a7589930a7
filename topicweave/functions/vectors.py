"""Array and score functions as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def list_array(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list column over one flat buffer."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * d, rows.ravel())


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of ``dim`` numbers a row as a matrix of doubles; a missing or shorter row is an error."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def l2_normalize(v: Column) -> Column:
    """Scale to unit length; an all-zero vector stays zero."""
    d = as_doubles(v)
    norm = F.sqrt(_sum(F.transform(d, lambda x: x * x)))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def softmax(scores: Column) -> Column:
    """Exponentials of the scores, shifted by their maximum, divided by their sum."""
    s = as_doubles(scores)
    top = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / _sum(e))


def argmax(scores: Column) -> Column:
    """0-based position of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def margin(probs: Column) -> Column:
    """Largest minus second largest value."""
    s = F.sort_array(probs, asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def ranked(scores: Column, labels: Column) -> Column:
    """Array of (label, score), highest score first; equal scores keep label order."""
    pairs = F.zip_with(labels, scores, lambda lab, s: F.struct((-s).alias("neg"), lab.alias("label")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["label"].alias("label"), (-p["neg"]).alias("score")))


def two_columns(score: Column) -> Column:
    """A single decision score as the score pair of classes 0 and 1."""
    return F.array(-score, score)


def one_hot(label: Column, classes: list) -> Column:
    return F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: (label == c).cast("int"))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def log_grid_point(i: Column, lo: float, hi: float, points: int) -> Column:
    """Point ``i`` (from 0) of a grid that is even in log10 between 10^lo and 10^hi."""
    return F.pow(F.lit(10.0), F.lit(lo) + i * F.lit(hi - lo) / F.lit(points - 1))


def to_log10(c: Column) -> Column:
    return F.log10(c)


def from_log10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)
