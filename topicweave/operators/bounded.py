"""Joins against a side that may or may not be small.

A side is broadcast only after its row count has been shown to fit; otherwise the join shuffles, with the rows of
hot keys spread over several salts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.session import staged

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 32
BITMAP_WORDS = 1 << 19  # at most 8 MB to broadcast


def spread(df: DataFrame) -> DataFrame:
    """Even out a small table, as it was read, before costly work on each row.

    A table with fewer partitions than there are cores (a few files with one row group each) would leave cores idle;
    it is also small, so moving it is cheap. Any larger one is returned as it is, without a shuffle. Call it on a scan
    only: counting the partitions of a frame that shuffles would run the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_or_none(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local relation if it has at most ``max_rows`` rows and ``MAX_BROADCAST_BYTES`` bytes, else None.

    Rows come to the driver one partition of the limit after the other, and only as long as both bounds hold.
    """
    sized = df.limit(max_rows + 1)
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = sized.agg(F.count(F.lit(1)), F.sum(width)).first()
    if rows > max_rows or (size or 0) > MAX_BROADCAST_BYTES:
        return None
    table = sized.toArrow()
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Column | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join ``df`` with a lookup table that has one row per key.

    Within ``max_rows`` the lookup is broadcast and ``df`` is not shuffled. Beyond that, every lookup row is copied
    to ``SALTS`` salts and each row of ``df`` picks one by hashing ``spread`` (any column that varies within a key),
    so a key holding a third of the rows still fans out over many tasks.
    """
    on = list(on)
    small = small_or_none(lookup, max_rows)
    if small is not None:
        return df.join(F.broadcast(small), on, how)
    if spread is None:
        return df.join(lookup, on, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(lookup.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")


def counted_join(
    df: DataFrame,
    counted: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Column,
    n_col: str = "n",
    share: int = 1024,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join ``df`` with ``counted``: one row per key, with a count ``n_col`` of the rows that key has. Null keys match.

    ``counted`` is written out once, since it is looked at several times. If it fits ``max_rows`` it is broadcast.
    Otherwise the hot keys, those with more than 1/``share`` of the counted rows, are known by proof to be fewer than
    ``share``: this list is broadcast, their rows in ``df`` are salted by hashing ``spread_by`` and their entries are
    copied to every salt. All other keys keep one salt. ``df`` is read and shuffled once.
    """
    on = list(on)
    counted = staged(counted, "counts")
    keys = counted.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in counted.columns if c not in on])
    drops = [f"_k_{c}" for c in on]

    def match(left: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [left[c].eqNullSafe(F.col(f"_k_{c}")) for c in on])

    small = small_or_none(keys, max_rows)
    if small is not None:
        return df.join(F.broadcast(small), match(df), how).drop(*drops)
    total = counted.agg(F.sum(n_col)).first()[0]
    is_hot = F.col(n_col) * F.lit(share) > F.lit(total)
    hot = keys.where(is_hot).select(*drops, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = df.join(F.broadcast(hot), match(df), "left").drop(*drops).withColumn("_salt", salt).drop("_hot")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = keys.withColumn("_copy", F.explode(copies))
    cond = match(left) & (left["_salt"] == F.col("_copy"))
    return left.join(right, cond, how).drop(*drops, "_salt", "_copy")


def unused(taken: Sequence[str], *wanted: str) -> list[str]:
    """Names for helper columns: ``wanted``, each with as many underscores behind it as it takes to differ from ``taken``
    and from each other (in any case of letters, as Spark compares them)."""
    seen, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def maybe_in(df: DataFrame, keys: DataFrame, col: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``col`` may be among ``keys``: none that is goes missing, a few others stay. With ``how``
    ``left_anti`` the other rows, none of which has a key. Null is never among the keys.

    The bitmap has ``BITMAP_WORDS`` words whatever the number of keys; with very many keys it merely filters less. It is
    built by a map-side combined aggregation and looked up by a broadcast join, all in generated code.
    """
    at, own, word, bits = unused([*df.columns, *keys.columns], "_at", "_own", "_word", "_bits")
    quoted = f"`{col}`"
    place = F.shiftright(F.pmod(F.xxhash64(quoted), F.lit(BITMAP_WORDS * 32)), 5)
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({quoted}), 32) as int))")
    bitmap = keys.where(F.col(quoted).isNotNull()).select(place.alias(word), bit.alias("bit")).groupBy(word)
    bitmap = bitmap.agg(F.bit_or("bit").alias(bits))
    marked = df.withColumns({at: F.when(F.col(quoted).isNotNull(), place), own: bit})
    same = (marked[at] == bitmap[word]) & (F.col(own).bitwiseAND(F.col(bits)) != 0)
    return marked.join(F.broadcast(bitmap), same, how).drop(at, own)
