"""Samples, balanced subsets, splits and folds of exact size.

All of them reduce to cut values in an order (a hash of seed and row id, or the row position), so the data is never
shuffled: rows are compared with the cut of their class. The result depends on seed and ids only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.functions.fixed_values import DEFAULT_SEED, N_FOLDS
from topicweave.operators.bounded import join_lookup
from topicweave.operators.ranking import (
    cut_points,
    first_n_per_group,
    group_totals,
    key_bucket,
    not_above,
    position_bucket,
    rank_in_group,
    sample_key,
    whole_table_cuts,
)
from topicweave.session import staged

_KEY = "_order_key"


def _by_key(seed: int, row_id: str):
    key = sample_key(seed, row_id)
    return key_bucket(key), {_KEY: key, row_id: F.col(row_id)}


def undersample(df: DataFrame, label: str, n: int, row_id: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """At most ``n`` random rows per label; rows without label are left out."""
    labelled = df.where(F.col(label).isNotNull())
    quotas = group_totals(labelled, [label]).select(label, F.lit(n).cast("bigint").alias("quota"))
    bucket, order = _by_key(seed, row_id)
    return first_n_per_group(labelled, [label], bucket, order, quotas).where("chosen").drop("chosen")


def balance(df: DataFrame, label: str, row_id: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Random rows of each label, as many as the smallest label has."""
    labelled = df.where(F.col(label).isNotNull())
    smallest = group_totals(labelled, [label]).agg(F.min("n")).first()[0] or 0
    return undersample(labelled, label, smallest, row_id, seed)


def sample_rows(df: DataFrame, max_rows: int, row_id: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """``max_rows`` random rows without replacement, or all rows if there are no more than that."""
    bucket, order = _by_key(seed, row_id)
    quota = df.sparkSession.createDataFrame([(max_rows,)], "quota bigint")
    return first_n_per_group(df, [], bucket, order, quota).where("chosen").drop("chosen")


def shuffle_rows(df: DataFrame, row_id: str, seed: int = DEFAULT_SEED, out: str = "row_pos") -> DataFrame:
    """A new random position 0..n-1 for every row."""
    key = sample_key(seed, row_id)
    keyed = df.withColumns({_KEY: key, "_bucket": key_bucket(key), "_all": F.lit(0)})
    ranked = rank_in_group(keyed, ["_all"], "_bucket", [F.col(_KEY), F.col(row_id)], "_rank")
    return ranked.withColumn(out, F.col("_rank") - 1).drop(_KEY, "_bucket", "_all", "_rank")


def _piece_number(df, groups, bucket, order, quotas, spread, out):
    """Number of cuts below each row: the piece (fold, part) it falls in. ``quotas`` lists the cuts of each group."""
    names = list(order)
    work = df.withColumns({"_bucket": bucket, **dict(order)})
    cuts = cut_points(work, groups, "_bucket", names, quotas)
    at = F.struct(*[F.col(n) for n in names])
    packed = cuts.groupBy(*groups).agg(
        F.collect_list(
            F.struct(F.col("keep_all"), F.col("quota"), F.struct(*[F.col(f"cut_{n}").alias(n) for n in names]).alias("cut"))
        ).alias("_cuts")
    )
    joined = join_lookup(work, packed, groups, "left", spread=spread)
    past = F.filter("_cuts", lambda c: ~c["keep_all"] & ((c["quota"] <= 0) | (at > c["cut"])))
    return joined.withColumn(out, F.size(past).cast("int")).select(*df.columns, out)


def split_contiguous(df: DataFrame, n_parts: int, pos: str, out: str = "part") -> DataFrame:
    """Number 0.. of the contiguous piece each row falls in; all pieces have ceil(N / n_parts) rows but the last ones."""
    total = df.count()
    size = math.ceil(total / n_parts) if total else 0
    ends = [(i * size,) for i in range(1, n_parts) if i * size < total]
    if not ends:
        return df.withColumn(out, F.lit(0))
    quotas = df.sparkSession.createDataFrame(ends, "quota bigint")
    bucketed = df.withColumn("_bucket", position_bucket(df, pos))
    cuts = whole_table_cuts(bucketed, "_bucket", [pos], quotas)
    return df.withColumn(out, reduce(lambda a, b: a + b, [(~not_above([pos], c)).cast("int") for c in cuts]))


def part_manifest(df: DataFrame, part: str, pos: str) -> DataFrame:
    return df.groupBy(part).agg(
        F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("n")
    )


def test_quotas(counts: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per class: ceil(test_size * N) in all, shared by largest remainder (smaller label first on ties).

    ``counts`` has one row per class, so ranking its remainders in one task is bounded by the number of classes.
    Whole-number arithmetic keeps the shares exact.
    """
    stats = counts.agg(F.sum("n"), F.min("n"), F.count(F.lit(1))).first()
    total, smallest, k = stats
    if not total:
        raise ValueError("nothing to split")
    if counts.where(F.col(label).isNull()).limit(1).count():
        raise ValueError("rows without a label cannot be split by class")
    if smallest < 2:
        raise ValueError("every class needs at least two rows")
    n_test = math.ceil(test_size * total)
    if n_test < k or total - n_test < k:
        raise ValueError("each side of the split needs at least one row per class")
    share = F.col("n") * F.lit(n_test)
    based = counts.withColumns(
        {"_floor": F.expr(f"n * {n_test} div {total}"), "_left": share % F.lit(total), "_all": F.lit(0)}
    )
    missing = n_test - based.agg(F.sum("_floor")).first()[0]
    order = [F.desc("_left"), F.asc(label)]
    rank = F.row_number().over(Window.partitionBy("_all").orderBy(*order))
    quota = F.col("_floor") + (rank <= F.lit(missing)).cast("bigint")
    return based.withColumn("quota", quota).select(label, "quota")


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_size: float = 0.2, seed: int = DEFAULT_SEED, out: str = "split"
) -> DataFrame:
    """Random train / test split with exact class shares."""
    quotas = test_quotas(staged(group_totals(df, [label]), "class-counts"), label, test_size)
    bucket, order = _by_key(seed, row_id)
    flagged = first_n_per_group(df, [label], bucket, order, quotas)
    return flagged.withColumn(out, F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen")


def _fold_quotas(df: DataFrame, label: str, folds: int, offset_order: Sequence[Column], extra) -> DataFrame:
    """Last rank of each fold but the final one, per class. The classes are counted once.

    Lay the classes end to end and deal the places out to the folds in turn: fold i of a class that starts at offset o
    gets the places r with (o + r) mod folds = i. Fold sizes then differ by at most one, overall and per class.
    """
    counts = staged(df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *extra), "class-counts")
    largest, unlabelled = counts.agg(F.max("n"), F.count_if(F.col(label).isNull())).first()
    if unlabelled:
        raise ValueError("rows without a label cannot be dealt to folds")
    if largest is not None and largest < folds:
        raise ValueError(f"no class has as many rows as there are folds ({folds})")
    counts = counts.withColumn("_all", F.lit(0))
    earlier = Window.partitionBy("_all").orderBy(*offset_order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_o", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    k = F.lit(folds)

    def upto(i: int) -> Column:
        out = F.lit(0).cast("bigint")
        for j in range(i + 1):
            out = out + F.floor((F.col("n") + k - 1 - F.pmod(F.lit(j) - F.col("_o"), k)) / k).cast("bigint")
        return out

    cuts = F.array(*[F.struct(F.lit(i).alias("piece_id"), upto(i).alias("quota")) for i in range(folds - 1)])
    return staged(placed.select(label, F.inline(cuts)), "fold-quotas")


def stratified_folds(
    df: DataFrame, label: str, row_id: str, folds: int = N_FOLDS, seed: int = DEFAULT_SEED, out: str = "fold"
) -> DataFrame:
    """Random stratified fold number of every row."""
    quotas = _fold_quotas(df, label, folds, [F.asc(label)], [])
    bucket, order = _by_key(seed, row_id)
    return _fold_number(df, label, bucket, order, quotas, folds, out)


def stratified_blocks(df: DataFrame, label: str, pos: str, folds: int = N_FOLDS, out: str = "fold") -> DataFrame:
    """Stratified fold number without shuffling: inside a class each fold is one block of consecutive rows. Classes
    are laid out by first appearance."""
    quotas = _fold_quotas(df, label, folds, [F.asc("_first")], [F.min(pos).alias("_first")])
    return _fold_number(df, label, position_bucket(df, pos), {pos: F.col(pos)}, quotas, folds, out)


def _fold_number(df, label, bucket, order, quotas, folds, out):
    return _piece_number(df, [label], bucket, order, quotas, F.col(next(iter(order))), out)
