"""FTRL-proximal logistic regression over hashed word features, used for toxicity (operator 3).

A text's features are the sets of its hashed words, word pairs, and pairs that skip one word; a word of more than
``STEM`` letters also counts by its beginning, a crude stem that serves inflecting and compounding languages. Each has a
weight; the score of a text is the logistic function of bias plus the weights of its features.

Training takes at most about ``MAX_TRAIN_ROWS`` labelled rows (a fixed function of doc_id chooses them; fewer labelled
rows are all taken). They are dealt over shards of about ``SHARD_ROWS`` rows; each shard runs FTRL-proximal with
per-coordinate rates and L1 sparsity over its rows ``EPOCHS`` times, in an order fixed by doc_id, and the weights of the
shards are averaged. L1 leaves only features that speak clearly, so what is collected and broadcast is small: never more
than 2^``FEATURE_BITS`` weights.

Labels are taken only from rows whose crc32 of the doc_id as text leaves a remainder other than 1 by 3; the rest is held
out. Of a doc_id with several labels the largest counts; null labels and ids do not train. Only the text is an input of
a score. Null and empty texts have no features and score by the bias alone. If no row has a label, every score is 0.5.
Repeated rows score equally; an empty table gives an empty result. Whole texts are used, slice by slice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import query, table
from topicweave.session import staged

FEATURE_BITS = 20
MAX_TRAIN_ROWS = 65_536
SHARD_ROWS = 16_384
MAX_SHARDS = 4
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.01
THRESHOLD = 0.7
BIAS = 1 << FEATURE_BITS
SLICE = 1 << 16
STEM = 5

WORD = re.compile(r"[^\W_]+")
#: odd multipliers of the hash, one for the first and one for the second word of each kind of feature
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of the features that occur in a text."""
    words = WORD.findall((text or "").lower())
    found = []
    shift = np.uint64(64 - FEATURE_BITS)
    with np.errstate(over="ignore"):
        for lo in range(0, len(words), SLICE):
            part = words[lo : lo + SLICE + 2]
            c = np.fromiter((zlib.crc32(w.encode()) for w in part), np.uint64)
            stems = np.fromiter((zlib.crc32(w[:STEM].encode()) for w in part if len(w) > STEM), np.uint64)
            kinds = (c * MIX[0] + MIX[3], c[:-1] * MIX[1] + c[1:] * MIX[2], c[:-2] * MIX[2] + c[2:] * MIX[3], stems * MIX[1] + MIX[0])
            mixed = np.concatenate(kinds)
            mixed ^= mixed >> np.uint64(31)
            found.append(np.unique(((mixed * MIX[0]) >> shift).astype(np.int32)))
    if len(found) == 1:
        return found[0]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def train(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in their order. Returns the features with a weight, and their weights."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(own) <= L1] = 0
        return w

    for _ in range(epochs):
        for found, y in zip(rows, labels, strict=True):
            at = np.append(found, BIAS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    kept = np.flatnonzero(np.abs(z) > L1)
    return kept, weights(kept)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_labels(labels: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(doc_id, y) of the training rows, and about how many there are: bounded, so they may be broadcast."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    n = own.count()
    if n > MAX_TRAIN_ROWS:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < MAX_TRAIN_ROWS)
    return own, min(n, MAX_TRAIN_ROWS)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            found = pa.array([features(x.as_py()) for x in part.column(3)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], found], ["shard", "pos", "y", "found"])


def fit(docs: DataFrame, labels: DataFrame, label: str) -> dict[str, np.ndarray]:
    """Weights learned from ``labels`` (doc_id, ``label``) on the texts of ``docs``."""
    chosen, n = sample_labels(labels, label)
    chosen = staged(chosen, "training-labels")
    shards = int(np.clip(-(-n // SHARD_ROWS), 1, MAX_SHARDS))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    pos = F.xxhash64("doc_id", "text")
    rows = rows.select(F.pmod(pos, F.lit(shards)).cast("int").alias("shard"), pos.alias("pos"), "y", "text")
    rows = rows.mapInArrow(_feature_batches, "shard int, pos bigint, y int, found array<int>")

    def fit_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        at, w = train([*pdf["found"]], [*pdf["y"]])
        return pd.DataFrame({"feature": at.astype("int64"), "w": w})

    parts = rows.groupBy("shard").applyInPandas(fit_shard, "feature long, w double")
    got = parts.groupBy("feature").agg((F.sum("w") / shards).alias("w")).where("w <> 0").toPandas()
    return {"feature": got["feature"].to_numpy(), "w": got["w"].to_numpy()}


def score(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of every row."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BIAS + 1)
        dense[cast.value["feature"]] = cast.value["w"]
        for batch in batches:
            total = np.array([dense[features(x.as_py())].sum() for x in batch.column(len(keep))]) + dense[BIAS]
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keep, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1]), "score double"])
    return narrow.mapInArrow(run, schema)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
