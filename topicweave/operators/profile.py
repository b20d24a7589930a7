"""Counts and summaries of article tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from topicweave.operators.bounded import join_lookup


def label_counts(df: DataFrame, label: str, by_count: bool = False) -> DataFrame:
    """Rows per label without null labels, sorted by label or by falling count."""
    out = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), label) if by_count else out.orderBy(label)


def crosstab(df: DataFrame, rows: str, label: str, labels: Sequence, prefix: str = "label_") -> DataFrame:
    """Rows per (row value, label) as a table with one column per given label, zero where there is none."""
    known = df.where(F.col(rows).isNotNull() & F.col(label).isin(list(labels)))
    wide = known.groupBy(rows).pivot(label, list(labels)).agg(F.count(F.lit(1)))
    cols = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(f"{prefix}{v}") for v in labels]
    return wide.select(rows, *cols).orderBy(rows)


def smallest_class(df: DataFrame, label: str) -> DataFrame:
    return label_counts(df, label).agg(F.min("n").alias("min_n"))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label)


def missing_ratio(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, missing values, and their share in percent with two decimals. One pass over the data."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)],
    )
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("missing")) for i, c in enumerate(cols)])
    pct = F.round(F.try_divide(F.col("missing") * 100.0, F.col("rows")), 2)
    return one.select("rows", F.inline(each)).select("column_name", "rows", "missing", pct.alias("missing_pct"))


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def fold_summary(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean and population standard deviation of a score over folds."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) of each class."""
    counts = label_counts(df, label)
    n, k = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    return counts.withColumn("weight", F.lit(float(n or 0)) / (F.lit(k) * F.col("n")))


def with_class_weight(df: DataFrame, label: str, spread: Column, out: str = "weight") -> DataFrame:
    """Give every row the balanced weight of its class."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return join_lookup(df, weights, [label], "left", spread=spread)


def kernel_gamma(df: DataFrame, features: str) -> DataFrame:
    """1 / (d * variance of all matrix entries), from counts and sums taken in one pass."""
    v = F.col(features).cast("array<double>")
    s1 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    sums = df.agg(F.sum(F.size(v)).alias("n"), F.sum(s1).alias("s1"), F.sum(s2).alias("s2"), F.max(F.size(v)).alias("d"))
    mean = F.col("s1") / F.col("n")
    var = F.col("s2") / F.col("n") - mean * mean
    return sums.select(F.col("d").cast("bigint").alias("d"), var.alias("var"), (1.0 / (F.col("d") * var)).alias("gamma"))


class StepReport:
    """Rows and columns of the frames of a job, counted while the job runs: no scan of their own.

    ``watch`` marks a frame; ``table`` lists the marked frames in order once the job is done, with the rows that are gone
    since the frame before. Counts ride along as observations, so a stage that is run again after a lost executor may
    count its rows twice; the data itself is not touched.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[str, int, Observation]] = []

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self.steps.append((step, len(df.columns), seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n_rows"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows, before = [], None
        for step, columns, seen in self.steps:
            n = seen.get.get("n_rows", 0)
            rows.append((step, n, columns, 0 if before is None else before - n))
            before = n
        return spark.createDataFrame(rows, "step string, n_rows long, n_columns long, removed long")
