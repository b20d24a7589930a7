"""Feature tables, captured pages and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = ("page_id", "url", "html")


def write_features(df: DataFrame, path: str, split: str = "split") -> None:
    """Feature table partitioned by split, so that reading one split skips the other's files. A table without split
    column becomes the split ``all``."""
    if split not in df.columns:
        df = df.withColumn(split, F.lit("all"))
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages, one HTML document per URL."""
    return spark.read.parquet(path).select(*PAGE_COLUMNS)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, stripped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("word"))
    return lines.where(F.col("word") != "")
