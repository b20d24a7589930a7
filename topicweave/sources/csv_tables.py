"""CSV corpora: reading with the usual missing-value texts, ordered ingest, and the different ways of writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicweave.functions.fixed_values import NA_LITERALS
from topicweave.operators.bounded import join_lookup
from topicweave.session import staged

_QUOTING = {"header": True, "quote": '"', "escape": '"'}


def _raw(spark: SparkSession, path: str, schema: StructType, multi_line: bool, glob: str | None) -> DataFrame:
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    reader = spark.read.schema(texts).options(**_QUOTING).option("multiLine", multi_line).option("enforceSchema", False)
    return (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)


def _typed(schema: StructType):
    """Missing-value texts become null, the rest is cast; text that does not fit its type is an error."""
    cells = [(f, F.col(f.name)) for f in schema.fields]
    return [F.when(~c.isin(NA_LITERALS), c).cast(f.dataType).alias(f.name) for f, c in cells]


def read_csv(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = True, glob: str | None = None
) -> DataFrame:
    """A CSV file, or all files of a directory, with a declared schema. The header must match it.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file; switch it off for large files
    without such breaks, which Spark can then split.
    """
    return _raw(spark, path, schema, multi_line, glob).select(*_typed(schema))


def ingest_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    table_path: str,
    multi_line: bool = True,
    glob: str | None = "*.csv",
    pos: str = "row_pos",
) -> DataFrame:
    """Turn CSV files into a parquet table with a row position: files by name, rows as they stand in the file.

    The rows are written once with their place inside their file piece, which freezes the order; a count per piece
    then gives each piece its offset. Only that list of pieces is ordered in one task.
    """
    raw = _raw(spark, path, schema, multi_line, glob)
    placed = raw.select(
        *_typed(schema),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    frozen = staged(placed, "ingest")
    piece = ["_file", "_path", "_start"]
    sizes = frozen.groupBy(*piece).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_all").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_all", F.lit(0)).select(*piece, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = join_lookup(frozen, offsets, piece, "inner", spread=F.col("_id"))
    out = joined.select((F.col("_before") + F.col("_id") - F.col("_first")).alias(pos), *[f.name for f in schema.fields])
    out.write.mode("overwrite").parquet(table_path)
    return spark.read.schema(out.schema).parquet(table_path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_QUOTING).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append with every field quoted; each file carries its own header."""
    df.write.mode("append").options(**_QUOTING).option("quoteAll", True).csv(path)


def write_partitioned(df: DataFrame, path: str, part: str, as_csv: bool = False) -> None:
    """One directory per part (row range, blank mark, split)."""
    writer = df.write.mode("overwrite").partitionBy(part)
    writer.options(**_QUOTING).csv(path) if as_csv else writer.parquet(path)
