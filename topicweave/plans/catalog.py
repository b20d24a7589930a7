"""Registry of named queries over the test tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.operators.bounded import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


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


def row_work(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table about to get costly work on each row."""
    return spread(table(spark, sf_dir, name))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: first line as title, the rest as content (null without a second line), the quality
    label (null where there is none)."""
    docs = row_work(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    cut = F.instr("text", "\n")
    content = F.when(cut > 0, F.substring("text", cut + 1, F.length("text")))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_pos"), "lang", "source", "text", "n_chars", "label",
        F.substring_index("text", "\n", 1).alias("title"), content.alias("content"),
    )


ARTICLES = """articles AS (
  SELECT d.doc_id AS row_pos, d.lang, d.source, d.text, d.n_chars, l.quality AS label,
         split_part(d.text, chr(10), 1) AS title,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) END AS content
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def key_sql(row_id: str, seed: int = 42) -> str:
    return f"md5(concat_ws(':', '{seed}', CAST({row_id} AS VARCHAR)))"


# RE2 spellings of the character classes used by functions.text
WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def squeeze_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{WS}]+', ' ', 'g'))"


def clean_sql(expr: str) -> str:
    return squeeze_sql(rf"regexp_replace({expr}, '[^\p{{L}}\p{{N}}_{WS}]', ' ', 'g')")


def words_sql(expr: str) -> str:
    return f"list_filter(string_split({squeeze_sql(expr)}, ' '), lambda w: w <> '')"
