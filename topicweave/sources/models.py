"""Model weights, run summaries and the score cache as parquet tables."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StringType, StructField, StructType

CACHE_SCHEMA = StructType(
    [
        StructField("model", StringType()),
        StructField("metric", StringType()),
        StructField("log_c", DecimalType(10, 6)),
        StructField("score", DoubleType()),
    ]
)


def save_model(model, spark: SparkSession, path: str) -> None:
    """One row per class: label, intercept, coefficients."""
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    from topicweave.operators.linear_svm import LinearModel

    rows = spark.read.parquet(path).orderBy("label").collect()  # one row per class
    weights = np.array([[*r["coef"], r["intercept"]] for r in rows])
    return LinearModel([r["label"] for r in rows], weights, rows[0]["c"], rows[0]["subset"])


def save_calibrated(model, spark: SparkSession, path: str) -> None:
    """One row per fold and class, with the sigmoid parameters next to the weights."""
    rows = [
        (f, int(k), float(m.c), float(model.slope[f, i]), float(model.offset[f, i]), float(m.weights[i, -1]), m.weights[i, :-1].tolist())
        for f, m in enumerate(model.models)
        for i, k in enumerate(model.classes)
    ]
    schema = "fold int, label int, c double, slope double, offset double, intercept double, coef array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_calibrated(spark: SparkSession, path: str):
    from topicweave.operators.calibrate import CalibratedModel
    from topicweave.operators.linear_svm import LinearModel

    rows = spark.read.parquet(path).orderBy("fold", "label").collect()
    folds = sorted({r["fold"] for r in rows})
    classes = [r["label"] for r in rows if r["fold"] == folds[0]]
    by_fold = [[r for r in rows if r["fold"] == f] for f in folds]
    models = [
        LinearModel(classes, np.array([[*r["coef"], r["intercept"]] for r in rs]), rs[0]["c"], f)
        for f, rs in zip(folds, by_fold)
    ]
    slope = np.array([[r["slope"] for r in rs] for rs in by_fold])
    offset = np.array([[r["offset"] for r in rs] for rs in by_fold])
    return CalibratedModel(classes, models, slope, offset)


def run_summary(
    spark: SparkSession, log10_c: float, accuracy: float, macro_f1: float, population: int, generations: int, evaluations: int
) -> DataFrame:
    """One row with the outcome of a search; the budget is nested and reports distinct evaluations."""
    row = (log10_c, 10.0**log10_c, "f1_macro", accuracy, macro_f1, (population, generations, evaluations))
    return spark.createDataFrame(
        [row],
        "log10_c double, c double, cv_objective string, test_accuracy double, test_f1_macro double, "
        "budget struct<population:int,generations:int,evaluations:int>",
    )


def save_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The score cache; an empty table if there is none yet. A score written twice by a retry counts once."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return stored.groupBy("model", "metric", "log_c").agg(F.max("score").alias("score"))


def append_cache(scores: DataFrame, path: str) -> None:
    scores.coalesce(1).write.mode("append").parquet(path)
