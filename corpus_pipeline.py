"""A corpus pipeline of five stages: documents in, packed training sequences out.

Each stage works on all rows its predecessor kept and returns the columns of ``documents``, but for the last, which
returns one row per packed piece. Rows are judged by their own stage's operator in ``topicweave.llm``:

1. ``quality_rules``: rows whose text the base rules or the adaptive thresholds reject go.
2. ``simhash.keep_one``: one row of each group of near copies (five-word shingles, similarity 0.8 or more) stays.
3. ``decontaminate``: rows that contain a passage of a benchmark item go.
4. ``secrets``: rows stay, secrets in their text are replaced by ``[kind]``, and ``n_chars`` follows.
5. ``packing``: texts become token sequences of fixed length; every piece has its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicweave.llm import decontaminate, packing, quality_rules, secrets, simhash
from topicweave.session import staged


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", by_quality),
    ("simhash near-dedup", without_copies),
    ("benchmark decontamination", without_leaks),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: fingerprints, spans and token ids have no counterpart in SQL; tests/llm holds run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
