"""Class probabilities from decision scores: a sigmoid per class, fitted on held-out folds and averaged over folds.

The fit follows Platt's smoothed targets; Newton's method in two parameters per (fold, class) needs only six sums per
step, which one grouped aggregation yields for all of them together (Lin, Lin and Weng, "A note on Platt's
probabilistic outputs for support vector machines", 2007).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from topicweave.functions.fixed_values import CALIBRATION_C, N_FOLDS
from topicweave.functions.vectors import list_array, matrix
from topicweave.operators.linear_svm import EVALUATE, TRAIN, LinearModel, fit_linear, pack_blocks
from topicweave.operators.sampling import stratified_blocks
from topicweave.session import staged, staging


@dataclass
class CalibratedModel:
    """One linear model per fold, with sigmoid parameters (folds x classes)."""

    classes: list
    models: list[LinearModel]
    slope: np.ndarray
    offset: np.ndarray


def held_out_scores(df: DataFrame, models: list[LinearModel], features: str, fold: str) -> DataFrame:
    """Scores of each row under the model that did not see its fold."""
    weights = np.stack([m.weights for m in models])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vecs, folds in batches:
            x, f = matrix(vecs, weights.shape[2] - 1), folds.to_numpy(zero_copy_only=False)
            out = np.empty((len(x), weights.shape[1]))
            for i in range(len(weights)):
                out[f == i] = x[f == i] @ weights[i, :, :-1].T + weights[i, :, -1]
            yield list_array(out)

    score = F.arrow_udf(run, ArrayType(DoubleType()))
    return df.withColumn("scores", score(F.col(features), F.col(fold)))


def fit_sigmoids(scored: DataFrame, groups: int, max_steps: int = 100, tol: float = 1e-12):
    """Sigmoid parameters for each group 0..groups-1 of ``scored`` (group, score, is_pos): p = 1 / (1 + exp(a*s + b)).

    A group that has not settled after ``max_steps`` steps is reported by a warning.
    """
    spark = scored.sparkSession
    n = np.zeros((groups, 2))
    for r in scored.groupBy("group", "is_pos").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows per group
        n[r["group"], int(r["is_pos"])] = r["n"]
    hi, lo = targets(n)

    def sums(pa_, pb_):
        table = pd.DataFrame({"group": np.arange(groups, dtype=np.int32), "a": pa_, "b": pb_, "hi": hi, "lo": lo})
        params = F.broadcast(spark.createDataFrame(table))
        joined = scored.join(params, "group")
        z = F.col("a") * F.col("score") + F.col("b")
        t = F.when(F.col("is_pos"), F.col("hi")).otherwise(F.col("lo"))
        e = F.exp(-F.abs(z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(e) - (1 - t) * z
        p = F.when(z >= 0, e / (1 + e)).otherwise(1 / (1 + e))
        s, d, h = F.col("score"), t - p, p * (1 - p)
        terms = {"f": loss, "ga": d * s, "gb": d, "haa": h * s * s, "hab": h * s, "hbb": h}
        rows = joined.groupBy("group").agg(*[F.sum(c).alias(k) for k, c in terms.items()]).toArrow().to_pydict()
        out = {k: np.zeros(groups) for k in terms}
        for k in terms:
            out[k][rows["group"]] = rows[k]
        return out

    return newton(n, sums, max_steps, tol)


TERMS = ("f", "ga", "gb", "haa", "hab", "hbb")


def targets(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed targets of positive and negative rows, from the counts (groups x (negative, positive))."""
    return (n[:, 1] + 1) / (n[:, 1] + 2), 1 / (n[:, 0] + 2)


def fit_held_out(held: DataFrame, folds: int, k: int, max_steps: int = 100, tol: float = 1e-12):
    """Sigmoid parameters (folds x classes) from rows (fold, y, scores), y being the place of the class.

    The scores stay one array per row: a step is one pass of Arrow batches, which hands back six sums per fold and class.
    """
    groups = folds * k
    n = np.zeros((groups, 2))
    for r in held.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():  # folds x classes rows
        n[r["fold"] * k : (r["fold"] + 1) * k, 0] += r["n"]
        n[r["fold"] * k + r["y"]] += (-r["n"], r["n"])
    hi, lo = targets(n)

    def sums(a, b):
        params = [v.reshape(folds, k) for v in (a, b, hi, lo)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, hi, lo = params
            out = np.zeros((len(TERMS), folds, k))
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y"))
                s = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                z = a[fold] * s + b[fold]
                t = np.where(np.arange(k) == y[:, None], hi[fold], lo[fold])
                e = np.exp(-np.abs(z))
                p = np.where(z >= 0, e / (1 + e), 1 / (1 + e))
                d, h = t - p, p * (1 - p)
                terms = (np.maximum(z, 0) + np.log1p(e) - (1 - t) * z, d * s, d, h * s * s, h * s, h)
                for i, term in enumerate(terms):
                    np.add.at(out[i], fold, term)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["i", "v"])

        got = held.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(len(TERMS) * groups)
        flat[got["i"].to_numpy()] = got["v"].to_numpy()
        return dict(zip(TERMS, flat.reshape(len(TERMS), groups)))

    a, b = newton(n, sums, max_steps, tol)
    return a.reshape(folds, k), b.reshape(folds, k)


def newton(n: np.ndarray, sums, max_steps: int, tol: float):
    """Newton's method with step halving for all groups at once; ``sums(a, b)`` is one pass over the data."""
    groups = len(n)
    a, b = np.zeros(groups), np.log((n[:, 0] + 1) / (n[:, 1] + 1))
    now = sums(a, b)
    step, live = np.ones(groups), n.sum(axis=1) > 0
    for _ in range(max_steps):
        haa, hbb = now["haa"] + 1e-12, now["hbb"] + 1e-12
        det = haa * hbb - now["hab"] ** 2
        da = -(hbb * now["ga"] - now["hab"] * now["gb"]) / det
        db = -(haa * now["gb"] - now["hab"] * now["ga"]) / det
        drop = -(da * now["ga"] + db * now["gb"])
        live &= step > 1e-10
        # this close the full step is right; what it leaves is the square of what it mends
        last = live & (drop <= tol * np.maximum(1.0, now["f"]))
        a, b = np.where(last, a + da, a), np.where(last, b + db, b)
        live &= ~last
        if not live.any():
            break
        ta, tb = np.where(live, a + step * da, a), np.where(live, b + step * db, b)
        new = sums(ta, tb)
        good = live & (new["f"] <= now["f"] - 1e-4 * step * drop)
        a, b = np.where(good, ta, a), np.where(good, tb, b)
        now = {k: np.where(good, new[k], now[k]) for k in now}
        step = np.where(good, 1.0, step / 2)
    else:
        warnings.warn(f"{int(live.sum())} of {groups} sigmoids have not settled after {max_steps} steps", stacklevel=2)
    return a, b


def fit_calibrated(
    df: DataFrame, features: str, label: str, pos: str, c: float = CALIBRATION_C, folds: int = N_FOLDS, tol: float = 1e-4
) -> CalibratedModel:
    """Train on all but one fold, fit the sigmoids on the held-out fold, for every fold. All folds train together."""
    with staging(df.sparkSession):
        folded = stratified_blocks(df, label, pos, folds)
        roles = [F.when(F.col("fold") == i, EVALUATE).otherwise(TRAIN) for i in range(folds)]
        blocks = pack_blocks(folded, features, label, pos, roles)
        try:
            fitted = fit_linear(blocks, [c], tol=tol)
        finally:
            blocks.close()
        models, k = [fitted[i, 0] for i in range(folds)], len(blocks.classes)
        labels = F.array(*[F.lit(v) for v in blocks.classes])
        held = held_out_scores(folded.select(features, label, "fold"), models, features, "fold")
        place = (F.array_position(labels, F.col(label)) - 1).cast("int")
        margins = staged(held.select(F.col("fold").cast("int").alias("fold"), place.alias("y"), "scores"), "margins").persist()
        try:
            slope, offset = fit_held_out(margins, folds, k)
        finally:
            margins.unpersist()
        return CalibratedModel(list(blocks.classes), models, slope, offset)


def predict_proba(df: DataFrame, model: CalibratedModel, features: str, out: str = "probs") -> DataFrame:
    """Class probabilities: sigmoids of each fold's scores, normalised per fold, then averaged over folds."""
    weights = np.stack([m.weights for m in model.models])
    slope, offset = model.slope, model.offset

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vecs in batches:
            x = matrix(vecs, weights.shape[2] - 1)
            total = np.zeros((len(x), weights.shape[1]))
            for w, a, b in zip(weights, slope, offset):
                z = np.clip(a * (x @ w[:, :-1].T + w[:, -1]) + b, -700, 700)
                p = 1.0 / (1.0 + np.exp(z))
                if p.shape[1] == 2:
                    p[:, 0] = 1.0 - p[:, 1]
                norm = p.sum(axis=1, keepdims=True)
                total += np.where(norm > 0, p / np.where(norm > 0, norm, 1.0), 1.0 / p.shape[1])
            yield list_array(total / len(weights))

    prob = F.arrow_udf(run, ArrayType(DoubleType()))
    return df.withColumn(out, prob(F.col(features)))
