"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.operators.bounded import maybe_in, unused

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def drop_rows(docs: DataFrame, bad: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the rows named in ``bad`` (doc_id, text_key and the columns ``also``), null-safe.

    A bitmap of fixed size sorts out the rows that cannot be among the bad ones; they are not shuffled. ``bad`` is read
    three times and should be a written table.
    """
    (key,) = unused(docs.columns, "_tk")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    names = bad.select(F.col("doc_id").alias("_bid"), F.col("text_key").alias("_bkey"), *[F.col(c).alias(f"_b_{c}") for c in also])
    keys = bad.select(F.col("text_key").alias(key))
    sure, open_ = maybe_in(keyed, keys, key, "left_anti"), maybe_in(keyed, keys, key)
    same = open_["doc_id"].eqNullSafe(names["_bid"]) & (open_[key] == names["_bkey"])
    for c in also:
        same = same & open_[c].eqNullSafe(names[f"_b_{c}"])
    return sure.unionByName(open_.join(names, same, "left_anti")).drop(key)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs inside send Arrow batches of about ``size`` bytes to Python: less memory on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_key(text: Column) -> Column:
    """A 64-bit digest of a text. Together with an id it names a row even where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
