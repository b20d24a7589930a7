"""A user's function per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GroupFunction = Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _pieces(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each group of one batch, nulls being a value of their own."""
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for key in keys:
        own = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    ends = np.flatnonzero(np.diff(codes[order])) + 1
    for rows in np.split(order, ends):
        part = batch.take(pa.array(rows))
        yield tuple(part.column(k)[0] for k in keys), part


def per_group(
    df: DataFrame, keys: Sequence[str], fn: GroupFunction, schema=None, combine: bool = False, max_rows: int | None = None
) -> DataFrame:
    """Apply ``fn(key values, batches) -> batches`` to every group; null keys form groups too.

    A group comes as a stream of Arrow batches, so its size is bounded by what ``fn`` keeps, not by memory. With
    ``combine`` the function also runs before the shuffle, on the rows of each group in each batch: right for functions
    whose result over parts equals that over the whole (the n least, sums, first of a key) and that return the columns they get. A
    group with a third of all rows then sends only a few rows per batch. Without ``combine``, ``max_rows`` refuses a
    table with a larger group before any work is done, and names the largest. An empty table gives no rows.
    """
    keys = list(keys)
    if combine and schema is not None:
        raise ValueError("a function that combines returns the columns it gets")
    if max_rows is not None and not combine:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows)
        if worst := sizes.orderBy(F.desc("n")).limit(5).collect():
            raise ValueError(f"groups of more than {max_rows} rows: {[tuple(r) for r in worst]}")

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for key, part in _pieces(batch, keys):
                    yield from fn(key, iter([part]))

    def late(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(key, batches)

    rows = df.mapInArrow(early, df.schema) if combine else df
    return rows.groupBy(*keys).applyInArrow(late, schema or df.schema)


def least(n: int, order: Sequence[str]) -> GroupFunction:
    """A function for ``per_group``: the ``n`` least rows along ``order``. Holds ``n`` rows and a batch at a time."""
    along = [(c, "ascending") for c in order]

    def fn(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if best is None else [best, batch])
            rows = rows.take(pc.sort_indices(rows, sort_keys=along)[:n]).combine_chunks()
            best = rows.to_batches()[0] if rows.num_rows else batch.slice(0, 0)
        if best is not None and best.num_rows:
            yield best

    return fn
