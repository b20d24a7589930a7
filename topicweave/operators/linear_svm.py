"""Many linear one-vs-rest classifiers trained together in shared passes over one feature table.

Each problem is one class against the rest, for one C, on one subset of the rows (a fold, a prefix, all rows):

    0.5 * |w|^2  +  C * sum_i a_i * max(0, 1 - y_i * (w . x_i))^2

with the bias as one more, regularised, weight. Balanced class weights apply to the positive side, n / (k * n_c);
with only two classes both sides carry the weight of their class. The objective is smooth and convex, so
any convergent method finds the same weights. One pass over the blocks evaluates loss and gradient of every problem at
its own trial point, and a problem that has converged leaves the pass. Directions come from L-BFGS while many problems
are open; once the curvature matrices of the open ones are small enough to sum, from Newton's method, which needs few
further passes even where C is large and L-BFGS would crawl. The driver holds weights and these matrices only.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from topicweave.functions.vectors import list_array, matrix
from topicweave.operators.metrics import macro_f1, pair_counts
from topicweave.session import staged

BLOCK_SCHEMA = "n int, d int, x binary, y binary, member binary"
PARTITION_BYTES = 128 << 20  # more than this per partition means another partition
SMALL_BYTES = 64 << 10  # less than this is not worth a task of its own
BLOCK_ROWS = 2048
TRAIN, EVALUATE, UNUSED = 1, 2, 0
DRIVER_BYTES = 64 << 20
CURVATURE_BYTES = 8 << 20  # per task
HISTORY = 10
STEPS = 0.5 ** np.arange(12)


@dataclass
class Blocks:
    """Feature rows packed into dense blocks, with class positions and subset membership."""

    table: DataFrame
    classes: list
    counts: np.ndarray  # training rows per (subset, class)
    dim: int
    parts: int

    def close(self) -> None:
        self.table.unpersist()


@dataclass
class LinearModel:
    """Weights (classes x (dim + 1), the intercept last) of one classifier."""

    classes: list
    weights: np.ndarray
    c: float
    subset: int = 0
    gradient: float = 0.0  # largest gradient of its problems, relative to the one at zero weights
    converged: bool = True

    def table(self, spark) -> DataFrame:
        rows = [
            (int(self.subset), float(self.c), int(k), float(w[-1]), [float(v) for v in w[:-1]])
            for k, w in zip(self.classes, self.weights)
        ]
        return spark.createDataFrame(rows, "subset int, c double, label int, intercept double, coef array<double>")


def pack_blocks(
    df: DataFrame, features: str, label: str, row_id: str, subsets: Sequence[Column] = ()
) -> Blocks:
    """Pack rows for training. Each column of ``subsets`` gives a row its role for one training set: ``TRAIN``,
    ``EVALUATE`` or ``UNUSED`` (default: one set that trains on all rows).

    One count per class and subset gives the class weights and the size of the table; the blocks are spread evenly by
    row id, written once to the shared folder and cached from there, so a lost executor re-reads them.
    """
    spark = df.sparkSession
    subsets = list(subsets) or [F.lit(TRAIN)]
    stats = (
        df.groupBy(label)
        .agg(F.max(F.size(features)).alias("d"), F.min(F.size(features)).alias("d_min"), F.count(F.lit(1)).alias("n"),
             *[F.count_if(s == TRAIN).alias(f"s{i}") for i, s in enumerate(subsets)])
        .orderBy(label).collect()
    )
    if not stats or any(r["d"] != stats[0]["d"] or r["d_min"] != stats[0]["d"] for r in stats):
        raise ValueError("all feature vectors must have one length")
    classes = [r[label] for r in stats]
    if None in classes:
        raise ValueError("rows without a label cannot train a model")
    if len(classes) < 2:
        raise ValueError("training needs at least two classes")
    dim, total = stats[0]["d"], sum(r["n"] for r in stats)
    counts = np.array([[r[f"s{i}"] for r in stats] for i in range(len(subsets))], dtype=np.int64)
    size = total * dim * 4
    cores = spark.sparkContext.defaultParallelism
    parts = max(min(cores, size // SMALL_BYTES + 1), size // PARTITION_BYTES + 1)
    member = F.array(*[s.cast("tinyint") for s in subsets])
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    slim = df.select(
        F.col(row_id).alias("id"), F.col(features).cast("array<float>").alias("x"), position.cast("int").alias("y"),
        member.alias("member"),
    ).repartition(parts, "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = np.ascontiguousarray(b.column("x").flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
            m = b.column("member").flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
            x, m = x.reshape(b.num_rows, -1), m.reshape(b.num_rows, -1)
            cuts = [slice(i, min(i + BLOCK_ROWS, b.num_rows)) for i in range(0, b.num_rows, BLOCK_ROWS)]
            cols = {
                "n": [c.stop - c.start for c in cuts],
                "d": [dim] * len(cuts),
                "x": [x[c].tobytes() for c in cuts],
                "y": [y[c].tobytes() for c in cuts],
                "member": [m[c].tobytes() for c in cuts],
            }
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], list(cols))

    table = staged(slim.mapInArrow(pack, BLOCK_SCHEMA), "blocks").persist()
    return Blocks(table, classes, counts, dim, table.rdd.getNumPartitions())


def _read_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with a constant bias column, class positions, role per subset."""
    n, d = row["n"], row["d"]
    x = np.ones((n, d + 1))
    x[:, :d] = np.frombuffer(row["x"], np.float32).reshape(n, d)
    return x, np.frombuffer(row["y"], np.int32), np.frombuffer(row["member"], np.uint8).reshape(n, -1)


def _batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _loss_and_gradient(blocks: Blocks, weights, target, subset, pos_cost, neg_cost, curvature=False):
    """Summed loss, gradient and (if asked for) curvature matrix of each problem; the results follow the problems."""
    spark = blocks.table.sparkSession
    m, d1 = weights.shape
    width = d1 + d1 * d1 if curvature else d1
    shared = spark.sparkContext.broadcast((weights.T.copy(), target, subset, pos_cost, neg_cost))

    def run(batches):
        w, tgt, sub, cp, cn = shared.value
        loss, out = np.zeros(m), np.zeros((m, width))
        for row in _batch_rows(batches):
            x, y, member = _read_block(row)
            positive = y[:, None] == tgt[None, :]
            slack = x @ w
            np.negative(slack, out=slack, where=positive)
            slack += 1.0
            np.maximum(slack, 0.0, out=slack)
            cost = np.where(positive, cp, cn) * (member[:, sub] == TRAIN)
            pull = cost * slack
            loss += (pull * slack).sum(axis=0)
            np.negative(pull, out=pull, where=positive)
            out[:, :d1] += 2.0 * (pull.T @ x)
            if curvature:
                for j in range(m):
                    on = np.flatnonzero((slack[:, j] > 0) & (cost[:, j] > 0))
                    near = x[on]
                    out[j, d1:] += 2.0 * ((near * cost[on, j, None]).T @ near).ravel()
        ids = pa.array(np.arange(m, dtype=np.int32))
        ends = pa.array(np.arange(0, m * width + 1, width, dtype=np.int32))
        flat = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(loss), flat], ["m", "loss", "sums"])

    sums = blocks.table.mapInArrow(run, "m int, loss double, sums array<double>")
    try:
        if blocks.parts * m * width * 8 > DRIVER_BYTES:
            sums = sums.groupBy("m").agg(
                F.sum("loss").alias("loss"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")
            )
        got = sums.toArrow()
        ids = got.column("m").to_numpy()
        loss, total = np.zeros(m), np.zeros((m, width))
        np.add.at(loss, ids, got.column("loss").to_numpy())
        flat = got.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        np.add.at(total, ids, flat)
    finally:
        shared.destroy()
    return loss, total[:, :d1], total[:, d1:].reshape(m, d1, d1) if curvature else None


def _direction(g, s_hist, y_hist, rho):
    """L-BFGS direction of each problem (two loops over the stored steps; an empty slot has rho zero)."""
    q, alphas = g.copy(), []
    for s, y, r in zip(reversed(s_hist), reversed(y_hist), reversed(rho)):
        a = r * np.einsum("md,md->m", s, q)
        q -= a[:, None] * y
        alphas.append(a)
    sy = np.einsum("md,md->m", s_hist[-1], y_hist[-1])
    yy = np.einsum("md,md->m", y_hist[-1], y_hist[-1])
    q *= np.where(rho[-1] > 0, sy / np.where(yy > 0, yy, 1.0), 1.0)[:, None]
    for s, y, r, a in zip(s_hist, y_hist, rho, reversed(alphas)):
        b = r * np.einsum("md,md->m", y, q)
        q += (a - b)[:, None] * s
    return -q


def minimise(evaluate, m: int, d1: int, tol: float = 1e-4, max_passes: int = 400):
    """Minimise ``m`` independent problems 0.5|w|^2 + loss(w). ``evaluate(ids, weights, curvature)`` is one pass over
    the data and yields loss, gradient and curvature sums (None if not asked for).

    A problem stops once its gradient is ``tol`` times the one at zero. Its step is cut (by interpolation) while the
    loss does not fall enough; other problems do not wait for it. When few problems are open, and full steps have
    begun to fail, a pass tries several steps of each at once. Returns weights, relative gradients and passes.
    """
    w = np.zeros((m, d1))

    def full(ids, at):
        small = len(ids) * d1 * d1 * 8 <= CURVATURE_BYTES
        loss, grad, curve = evaluate(ids, at, small)
        return loss + 0.5 * np.einsum("md,md->m", at, at), grad + at, None if curve is None else curve + np.eye(d1)

    f, g, curve = full(np.arange(m), w)
    g0 = np.maximum(np.linalg.norm(g, axis=1), 1e-300)
    hist_s, hist_y = [np.zeros((m, d1)) for _ in range(HISTORY)], [np.zeros((m, d1)) for _ in range(HISTORY)]
    rho = [np.zeros(m) for _ in range(HISTORY)]
    step, move = 1.0 / np.maximum(1.0, g0), -g
    if curve is not None:
        step, move = np.ones(m), -np.linalg.solve(curve, g[:, :, None])[:, :, 0]
    live, short = np.linalg.norm(g, axis=1) > tol * g0, np.zeros(m, dtype=bool)
    passes = 1
    while live.any() and passes < max_passes:
        ids = np.flatnonzero(live)
        room = CURVATURE_BYTES // (len(ids) * d1 * d1 * 8)
        tries = int(np.clip(room, 1, len(STEPS))) if short[ids].any() else 1
        steps = step[ids, None] * STEPS[:tries]
        trials = w[ids, None, :] + steps[:, :, None] * move[ids, None, :]
        f_all, g_all, curve = full(np.repeat(ids, tries), trials.reshape(-1, d1))
        passes += 1
        pick = f_all.reshape(-1, tries).argmin(axis=1)
        at = np.arange(len(ids)) * tries + pick
        trial, f_new, g_new = trials[np.arange(len(ids)), pick], f_all[at], g_all[at]
        curve = None if curve is None else curve[at]
        step[ids] = steps[np.arange(len(ids)), pick]
        short[ids] = step[ids] < 1.0
        slope = np.einsum("md,md->m", g[ids], move[ids])
        good = f_new <= f[ids] + 1e-4 * step[ids] * slope + 1e-12 * np.abs(f[ids])
        ok, bad = ids[good], ids[~good]
        short[bad] = True
        if bad.size:
            t, sl = step[bad], slope[~good]
            fit = -sl * t * t / (2.0 * np.maximum(f_new[~good] - f[bad] - sl * t, 1e-300))
            step[bad] = np.clip(fit, 0.1 * t, 0.5 * t)
            live[bad[step[bad] < 1e-12]] = False
        if ok.size:
            s, y = trial[good] - w[ok], g_new[good] - g[ok]
            w[ok], f[ok], g[ok] = trial[good], f_new[good], g_new[good]
            if curve is not None:
                move[ok] = -np.linalg.solve(curve[good], g[ok][:, :, None])[:, :, 0]
            else:
                sy = np.einsum("md,md->m", s, y)
                for h in (hist_s, hist_y, rho):
                    for i in range(HISTORY - 1):
                        h[i][ok] = h[i + 1][ok]
                hist_s[-1][ok], hist_y[-1][ok] = s, y
                rho[-1][ok] = np.where(sy > 0, 1.0 / np.where(sy > 0, sy, 1.0), 0.0)
                move[ok] = _direction(g[ok], [h[ok] for h in hist_s], [h[ok] for h in hist_y], [r[ok] for r in rho])
            uphill = np.einsum("md,md->m", move[ok], g[ok]) >= 0
            move[ok[uphill]] = -g[ok[uphill]]
            step[ok] = 1.0
            live[ok] = np.linalg.norm(g[ok], axis=1) > tol * g0[ok]
    return w, np.linalg.norm(g, axis=1) / g0, passes


def fit_linear(
    blocks: Blocks,
    c_values: Sequence[float] = (1.0,),
    balanced: bool = True,
    tol: float = 1e-4,
    max_passes: int = 400,
    subsets: Sequence[int] | None = None,
) -> dict[tuple[int, int], LinearModel]:
    """Train every (subset, C) classifier of the blocks together. Keys of the result: (subset, index of C). ``subsets``
    restricts training to some of the subsets.

    A class without rows in a subset gets no problem there and can never be predicted by that classifier. A model that
    has not reached ``tol`` after ``max_passes`` says so (``converged``, ``gradient``), and a warning is given.
    """
    k = len(blocks.classes)
    subsets = list(range(blocks.counts.shape[0]) if subsets is None else subsets)
    if not subsets:
        raise ValueError("no subset to train on")
    problems, weight_of = [], {}
    for sub in subsets:
        n_c = blocks.counts[sub]
        present = np.flatnonzero(n_c)
        if len(present) < 2:
            raise ValueError("a training subset holds fewer than two classes")
        size = n_c.sum() / (len(present) * np.maximum(n_c, 1)) if balanced else np.ones(k)
        binary = len(present) == 2
        for ci, c in enumerate(c_values):
            for cls in present[1:] if binary else present:
                neg = size[present[0]] if binary else 1.0
                weight_of[sub, ci, cls] = len(problems)
                problems.append((cls, sub, c * size[cls], c * neg))
    target, subset, pos, neg = (np.array(v) for v in zip(*problems))

    def evaluate(ids, at, curvature):
        return _loss_and_gradient(blocks, at, target[ids], subset[ids], pos[ids], neg[ids], curvature)

    w, gradient, passes = minimise(evaluate, len(problems), blocks.dim + 1, tol, max_passes)
    open_still = int((gradient > tol).sum())
    if open_still:
        warnings.warn(
            f"{open_still} of {len(problems)} problems stopped above a relative gradient of {tol:g} after {passes} passes", stacklevel=2
        )
    out = {}
    for sub in subsets:
        present = np.flatnonzero(blocks.counts[sub])
        for ci, c in enumerate(c_values):
            table = np.zeros((k, blocks.dim + 1))
            table[:, -1] = -1e30  # absent classes lose every comparison
            if len(present) == 2:
                one = w[weight_of[sub, ci, present[1]]]
                table[present[0]], table[present[1]] = -one, one
            else:
                for cls in present:
                    table[cls] = w[weight_of[sub, ci, cls]]
            own = [weight_of[sub, ci, cls] for cls in present if (sub, ci, cls) in weight_of]
            worst = float(gradient[own].max())
            out[sub, ci] = LinearModel(list(blocks.classes), table, float(c), sub, worst, worst <= tol)
    return out


def decision_scores(df: DataFrame, model: LinearModel, features: str, out: str = "scores") -> DataFrame:
    """One score per class, in the order of ``model.classes``. A narrow Arrow stage; the weights travel with it."""
    weights = model.weights

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vecs in batches:
            yield list_array(matrix(vecs, weights.shape[1] - 1) @ weights[:, :-1].T + weights[:, -1])

    score = F.arrow_udf(run, ArrayType(DoubleType()))
    return df.withColumn(out, score(F.col(features)))


def predict(
    df: DataFrame, model: LinearModel, features: str, out: str = "prediction", scores: str | None = None
) -> DataFrame:
    """Class with the highest score; the lower class wins a tie. ``scores`` keeps the scores in a column of that name."""
    at = scores or "_scores"
    classes = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_position(at, F.array_max(at)) - 1
    rows = decision_scores(df, model, features, at).withColumn(out, F.get(classes, best.cast("int")))
    return rows if scores else rows.drop(at)


def subset_scores(blocks: Blocks, models: dict[tuple[int, int], LinearModel]) -> DataFrame:
    """Macro F1 of every model on the training and on the evaluation rows of its subset.

    Columns: subset, c, role, macro_f1. One pass: each task counts (truth, prediction) pairs of all models.
    """
    spark = blocks.table.sparkSession
    keys = sorted(models)
    k = len(blocks.classes)
    stacked = np.vstack([models[key].weights for key in keys]).T.copy()
    subs = np.array([key[0] for key in keys])
    shared = spark.sparkContext.broadcast((stacked, subs))

    def run(batches):
        w, sub = shared.value
        total = np.zeros((len(sub), 3, k, k), dtype=np.int64)
        for row in _batch_rows(batches):
            x, y, member = _read_block(row)
            best = (x @ w).reshape(len(y), len(sub), k).argmax(axis=2)
            for j, s in enumerate(sub):
                cell = (member[:, s].astype(np.int64) * k + y) * k + best[:, j]
                total[j] += np.bincount(cell, minlength=3 * k * k).reshape(3, k, k)
        total[:, UNUSED] = 0
        j, role, y, p = np.nonzero(total)
        cols = [pa.array(v.astype(np.int32)) for v in (j, role, y, p)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(total[j, role, y, p])], ["j", "role", "yt", "yp", "cnt"])

    counted = blocks.table.mapInArrow(run, "j int, role int, yt int, yp int, cnt bigint")
    pairs = counted.groupBy("j", "role", F.col("yt").alias("y_true"), F.col("yp").alias("y_pred")).agg(
        F.sum("cnt").alias("n")
    )
    subset = F.array(*[F.lit(int(s)) for s in subs])
    c_of = F.array(*[F.lit(float(models[key].c)) for key in keys])
    return macro_f1(pairs, ["j", "role"]).select(
        F.get(subset, F.col("j")).alias("subset"), F.get(c_of, F.col("j")).alias("c"), "role", "macro_f1"
    )


def evaluate_model(df: DataFrame, model: LinearModel, features: str, label: str) -> DataFrame:
    """(truth, prediction, n) counts of a model on a labelled table; input of the metrics."""
    return pair_counts(predict(df, model, features), label, "prediction")
