"""Exact ranks, running sums and top-n selections over groups of any size.

A plain window over a group puts the whole group into one task. Here every row carries a *bucket*: a value that never
decreases along the order. A small histogram (group, bucket, count) tells how many rows come before each bucket, so
only rows that share one bucket ever have to meet in one task, and a selection needs no shuffle of the data at all:
it is a comparison with the exact cut value of the group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.operators.bounded import join_lookup, small_or_none

BUCKETS = 4096


def sample_key(seed: int, *ids: str | Column) -> Column:
    """Pseudo-random order key: a fixed function of seed and row id, so it depends on neither partitions nor retries."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def key_bucket(key: Column) -> Column:
    """First three hex digits of an md5 key: 4096 equally filled buckets, ordered like the key."""
    return F.substring(key, 1, 3)


def position_bucket(df: DataFrame, pos: str, buckets: int = BUCKETS) -> Column:
    """Equal-width buckets over a position column, apart for the bulk of the positions and for the few before and after
    it: an outlying position does not stretch the buckets of all others."""
    lo, hi = df.agg(F.min(pos), F.max(pos)).first()
    if lo is None:
        return F.lit(0).cast("bigint")
    first, last = df.approxQuantile(pos, [0.01, 0.99], 0.005)
    first, last = max(lo, math.floor(first)), min(hi, math.ceil(last))

    def cut(begin: int, end: int, offset: int) -> Column:
        width = max(1, -(-(end - begin + 1) // buckets))
        return F.floor((F.col(pos) - F.lit(begin)) / F.lit(width)).cast("bigint") + F.lit(offset)

    outside = F.when(F.col(pos) < first, cut(lo, first, 0)).when(F.col(pos) > last, cut(last, hi, 4 * buckets))
    return outside.otherwise(cut(first, last, 2 * buckets))


def with_quantile_bucket(df: DataFrame, value: str, out: str, buckets: int = 512) -> DataFrame:
    """Buckets of about equal size over a numeric column of unknown distribution; ``out`` grows with ``value``."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(value, probs, 0.5 / buckets)))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    descending_bucket: bool = False,
) -> DataFrame:
    """Add, per group, inclusive running sums along ``order``. One shuffle, on (group, bucket)."""
    groups = list(groups)
    parts = df.groupBy(*groups, bucket).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    along = F.desc(bucket) if descending_bucket else F.asc(bucket)
    earlier = Window.partitionBy(*groups).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        *groups, bucket, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(before, [*groups, bucket])
    for name, col in sums.items():
        out = out.withColumn(name, F.col(f"_b_{name}") + F.sum(col).over(inside))
    return out.drop(*[f"_b_{n}" for n in sums])


def rank_in_group(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], out: str) -> DataFrame:
    """Exact 1-based rank along ``order`` inside each group."""
    return running_sums(df, groups, bucket, order, {out: F.lit(1).cast("bigint")})


def group_totals(df: DataFrame, groups: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias(out))


def cut_points(
    df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[str], quotas: DataFrame
) -> DataFrame:
    """For each row of ``quotas`` (group columns, any ids, ``quota``): the order values of the quota-th row.

    Output: all columns of ``quotas``, ``keep_all`` (the group has no more than ``quota`` rows) and ``cut_<order>``
    columns (null when there is no such row). ``order`` must identify a row. A row is among the first ``quota`` of its
    group exactly when ``keep_all`` or its order values are not above the cut.
    """
    groups, order = list(groups), list(order)
    ids = [c for c in quotas.columns if c not in (*groups, "quota")]
    hist = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*groups).orderBy(bucket)
    upto = hist.withColumn("_upto", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    counted = upto.withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups)))
    before = F.col("_upto") - F.col("_n")
    joined = counted.join(quotas, groups)
    # one row per quota: the bucket in which it ends, or the last bucket if the group is smaller
    ends = (F.col("quota") > before) & (F.col("quota") <= F.col("_upto"))
    whole = (F.col("quota") >= F.col("_total")) & (F.col("_upto") == F.col("_total"))
    none = (F.col("quota") <= 0) & (before == 0)
    edges = joined.where(ends | whole | none).select(
        *groups, *ids, "quota", bucket,
        (F.col("quota") >= F.col("_total")).alias("keep_all"),
        (F.col("quota") - before).alias("_need"),
    )
    local = small_or_none(edges)
    edges = local if local is not None else edges
    open_edges = edges.where(~F.col("keep_all") & (F.col("quota") > 0))
    touched = open_edges.select(*groups, bucket).distinct()
    slim = df.select(*groups, bucket, *order)
    slim = slim.join(F.broadcast(touched) if local is not None else touched, [*groups, bucket], "left_semi")
    in_bucket = Window.partitionBy(*groups, bucket).orderBy(*order)
    ranked = slim.withColumn("_need", F.row_number().over(in_bucket).cast("bigint"))
    found = ranked.join(
        F.broadcast(open_edges) if local is not None else open_edges, [*groups, bucket, "_need"]
    ).select(*groups, *ids, "quota", *[F.col(o).alias(f"cut_{o}") for o in order])
    return edges.select(*groups, *ids, "quota", "keep_all").join(found, [*groups, *ids, "quota"], "left")


def within_cut(order: Sequence[str]) -> Column:
    """True for rows among the first ``quota`` of their group, after a join with ``cut_points``."""
    at = F.struct(*[F.col(o) for o in order])
    cut = F.struct(*[F.col(f"cut_{o}").alias(o) for o in order])
    below = F.col(f"cut_{order[0]}").isNotNull() & (at <= cut)
    return F.coalesce(F.col("keep_all") | below, F.lit(False))


def first_n_per_group(
    df: DataFrame, groups: Sequence[str], bucket: Column, order: Mapping[str, Column], quotas: DataFrame
) -> DataFrame:
    """Flag ``chosen`` on every row: is it among the first ``quota`` rows of its group along ``order``?

    ``quotas`` has one row per group. Without group columns the whole table is one group.
    """
    names = list(order)
    work = df.withColumns({"_bucket": bucket, **dict(order)})
    if not groups:
        found = whole_table_cuts(work, "_bucket", names, quotas)  # none for an empty table
        cut = found[0] if found else {"keep_all": True}
        chosen = F.lit(True) if cut["keep_all"] else not_above(names, cut)
        return work.withColumn("chosen", chosen).select(*df.columns, "chosen")
    cuts = cut_points(work, groups, "_bucket", names, quotas)
    joined = join_lookup(work, cuts, groups, "left", spread=F.col(names[0]))
    return joined.withColumn("chosen", within_cut(names)).select(*df.columns, "chosen")


def whole_table_cuts(df: DataFrame, bucket: str, order: Sequence[str], quotas: DataFrame) -> list:
    """The cuts of a table that is one single group: as many rows as there are quotas, in their order."""
    one = df.select(F.lit(0).alias("_all"), bucket, *order)
    return cut_points(one, ["_all"], bucket, order, quotas.withColumn("_all", F.lit(0))).orderBy("quota").collect()


def not_above(order: Sequence[str], cut) -> Column:
    """True for rows up to the cut. A cut without values (a quota of zero) has no rows."""
    if cut[f"cut_{order[0]}"] is None:
        return F.lit(False)
    at = F.struct(*[F.col(o) for o in order])
    return at <= F.struct(*[F.lit(cut[f"cut_{o}"]).alias(o) for o in order])
