"""Exact RBF kernel machines, one against one, trained by a cascade of solvers.

Each pair of classes is a problem of its own. Its rows are dealt over parts by hash; every part solves the dual problem of
its rows and hands on its support vectors only. Two parts merge and are solved again, until one is left. A pass over all
rows then looks for those that violate the optimality conditions of that solution: they are dealt over parts again, each
part together with the support vectors found so far. Support vectors of a subset stay in the problem until a larger subset
drops them, so the dual objective grows from round to round, and when no row violates the conditions by more than ``tol``
the solution is that of one solver over all rows. (Graf et al., "Parallel support vector machines: the cascade SVM", 2004.)

A task holds the rows of a part; after the first level these are support vectors. The last solver of a pair holds all of its
support vectors, as any exact kernel machine must. Scoring reads them in chunks of at most ``CHUNK_BYTES``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.session import staged

PART_ROWS = 16_384
CACHE_ROWS = 1024
BLOCK_ROWS = 256  # variables that are solved together
BLOCK_STEPS = 8  # steps for each of them, at most, before others are looked at
CHUNK_BYTES = 64 << 20
SCORE_ROWS = 1024  # a block of kernel values has at most the square of it
MAX_ROUNDS = 30


@dataclass
class KernelModel:
    """Support vectors (``pair``, ``id``, ``sign``, ``alpha``, ``x``) of every pair of classes, and a bias for each."""

    classes: list
    pairs: list[tuple[int, int]]
    vectors: DataFrame
    bias: np.ndarray
    gamma: float
    rounds: int = 0
    converged: bool = True


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(apart, 0))


class _Rows:
    """Rows of a kernel matrix, the last ones used kept."""

    def __init__(self, x: np.ndarray, gamma: float) -> None:
        self.x, self.gamma, self.kept, self.norms = x, gamma, {}, (x * x).sum(axis=1)

    def __getitem__(self, some: np.ndarray) -> np.ndarray:
        """The rows of some numbers; those that are not kept are computed together."""
        new = [i for i in some.tolist() if i not in self.kept]
        if new:
            apart = self.x[new] @ self.x.T
            apart *= -2
            apart += self.norms[new][:, None]
            apart += self.norms
            np.maximum(apart, 0, out=apart)
            apart *= -self.gamma
            self.kept |= zip(new, map(np.copy, np.exp(apart, out=apart)))
        rows = np.stack([self.kept[i] for i in some.tolist()])
        for i in some.tolist():  # the last used come last
            self.kept[i] = self.kept.pop(i)
        while len(self.kept) > CACHE_ROWS:
            self.kept.pop(next(iter(self.kept)))
        return rows


def solve(
    x: np.ndarray, sign: np.ndarray, cost: np.ndarray, gamma: float, tol: float, start: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Dual variables and bias of one problem: blocks of the variables that violate most, each by steps over two
    variables, chosen by first and second order, until the largest violation is below ``tol``. ``start``: dual variables that keep the constraints, to go on from."""
    alpha = np.zeros(len(sign)) if start is None else start.copy()
    grad, rows, held = -np.ones(len(sign)), _Rows(x, gamma), np.flatnonzero(alpha)
    for lo in range(0, len(held) and len(sign), SCORE_ROWS):
        part = slice(lo, lo + SCORE_ROWS)
        for at in range(0, len(held), SCORE_ROWS):
            some = held[at : at + SCORE_ROWS]
            grad[part] += sign[part] * (rbf(x[part], x[some], gamma) @ (sign[some] * alpha[some]))
    while True:
        slope = -sign * grad
        up = np.where(np.where(sign > 0, alpha < cost, alpha > 0), slope, -np.inf)
        down = np.where(np.where(sign > 0, alpha > 0, alpha < cost), slope, np.inf)
        most, least = up.max(), down.min()
        if most - least < tol:
            return alpha, float(most + least) / 2
        half = min(BLOCK_ROWS // 2, len(sign))
        block = np.union1d(np.argpartition(-up, half - 1)[:half], np.argpartition(down, half - 1)[:half])
        near = rows[block]
        before = alpha[block]
        alpha[block] = _steps(near[:, block], sign[block], cost[block], before, grad[block], max(tol, (most - least) / 8) / 2)
        grad += sign * (((alpha[block] - before) * sign[block]) @ near)


def _steps(
    near: np.ndarray, sign: np.ndarray, cost: np.ndarray, alpha: np.ndarray, grad: np.ndarray, tol: float
) -> np.ndarray:
    """Dual variables of a block, the others held: steps over two variables until the block's violation is below ``tol``."""
    alpha, slope, plus = alpha.copy(), -sign * grad, sign > 0
    # a variable is looked at as sign * alpha between its bounds
    low, high, value = np.where(plus, 0.0, -cost), np.where(plus, cost, 0.0), sign * alpha
    curves = np.maximum(2 - 2 * near, 1e-12)
    for _ in range(BLOCK_STEPS * len(sign)):
        i = int(np.argmax(np.where(value < high, slope, -np.inf)))
        gap = np.where(value > low, slope[i] - slope, -np.inf)
        if gap.max() < tol:
            break
        j = int(np.argmax(np.where(gap > 0, gap * gap / curves[i], -np.inf)))
        room_i, room_j = high[i] - value[i], value[j] - low[j]
        step = min(gap[j] / curves[i, j], room_i, room_j)
        # at a bound exactly, whatever the rounding
        value[i] = high[i] if step == room_i else value[i] + step
        value[j] = low[j] if step == room_j else value[j] - step
        slope -= (near[i] - near[j]) * step
    return sign * value


def _solve_part(c: float, weights: np.ndarray, gamma: float, tol: float):
    """Support vectors of a part; a part with one class only hands on all of its rows.

    The solver goes on from the dual variables that the rows bring with them: together those of two parts keep the
    constraints, and so does their mean where the parts have rows in common.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shared = 2.0 if pdf["id"].duplicated().any() else 1.0
        brought = pdf.groupby("id", dropna=False)["alpha"].sum().to_numpy() / shared  # sorted by id, null last
        pdf = pdf.drop_duplicates("id").sort_values("id", ignore_index=True)
        sign = pdf["sign"].to_numpy(np.float64)
        if (sign == sign[0]).all():
            return pdf.assign(alpha=0.0, bias=0.0)
        pair = weights[pdf["pair"].iloc[0]]
        cost = c * np.where(sign > 0, pair[0], pair[1])
        if abs(sign @ brought) > 1e-9 * cost.max() or (brought > cost).any():  # one id stood for different rows
            brought = np.zeros(len(sign))
        alpha, bias = solve(np.stack(pdf["x"].to_numpy()).astype(np.float64), sign, cost, gamma, tol, brought)
        return pdf.assign(alpha=alpha, bias=bias)[alpha > 0]

    return run


def _cascade(rows: DataFrame, parts: int, run) -> DataFrame:
    """Solve ``rows`` (pair, part, id, sign, x, alpha) part by part, merging two parts at a time; ``parts`` is a power of two."""
    schema = f"pair int, part bigint, id {dict(rows.dtypes)['id']}, sign double, x array<float>, alpha double, bias double"
    while True:
        found = staged(rows.groupBy("pair", "part").applyInPandas(run, schema), "support-vectors")
        if parts == 1:
            return found
        parts //= 2
        rows = found.select("pair", F.floor(F.col("part") / 2).alias("part"), "id", "sign", "x", "alpha")


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def fit_kernel(
    df: DataFrame, features: str, label: str, row_id: str, c: float = 1.0, gamma: float = 1.0, tol: float = 1e-3, balanced: bool = False
) -> KernelModel:
    """Train one machine for each pair of classes. ``row_id`` must be unique. With ``balanced`` a row costs n / (k * n_c)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    if None in counts or len(counts) < 2:
        raise ValueError("training needs labels of at least two classes, and no row without one")
    classes = sorted(counts)
    pairs = [*combinations(range(len(classes)), 2)]
    cost = [sum(counts.values()) / (len(classes) * counts[k]) if balanced else 1.0 for k in classes]
    weights = np.array([(cost[i], cost[j]) for i, j in pairs])
    mine = {k: [(n, 1.0 if i == k else -1.0) for n, (i, j) in enumerate(pairs) if k in (i, j)] for k in range(len(classes))}
    listed = F.array(*[F.array(*[F.struct(F.lit(n).alias("pair"), F.lit(s).alias("sign")) for n, s in mine[k]]) for k in mine])
    place = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col(label)).cast("int") - 1
    rows = df.select(F.col(row_id).alias("id"), F.col(features).cast("array<float>").alias("x"), F.explode(F.get(listed, place)).alias("p"))
    rows = staged(rows.select("p.pair", "id", "p.sign", "x"), "pair-rows")
    largest = sum(sorted(counts.values())[-2:])
    parts = _power_of_two(-(-largest // PART_ROWS))
    run = _solve_part(c, weights, gamma, tol)
    fresh = F.lit(0.0).alias("alpha")
    found = _cascade(rows.select("*", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), fresh), parts, run)
    for turn in range(1, MAX_ROUNDS + 1):
        bias = np.zeros(len(pairs))
        for r in found.groupBy("pair").agg(F.max("bias").alias("bias")).collect():  # a row per pair
            bias[r["pair"]] = r["bias"]
        model = KernelModel(classes, pairs, found.drop("part", "bias"), bias, gamma, turn)
        # rows without a dual variable must lie outside the margin
        outside = rows.join(found.select("pair", "id"), ["pair", "id"], "left_anti")
        bad = _own_scores(outside, model).where(F.col("sign") * F.col("score") < 1 - 2 * tol)
        bad = staged(bad.select("pair", "id", "sign", "x"), "violations")
        worst = bad.groupBy("pair").count().agg(F.max("count")).first()[0]
        if not worst:
            return model
        parts = _power_of_two(-(-worst // PART_ROWS))
        open_pairs = F.broadcast(bad.select("pair").distinct())  # no more rows than pairs
        old = found.select("pair", "id", "sign", "x", "alpha").join(open_pairs, "pair")
        old = old.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        new = bad.select("*", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), fresh)
        again = _cascade(old.unionByName(new), parts, run)
        found = staged(again.unionByName(found.join(open_pairs, "pair", "left_anti")), "support-vectors")
    warnings.warn(f"after {MAX_ROUNDS} rounds some rows still violate the margin", stacklevel=2)
    model.converged = False
    return model


def _chunks(rows: DataFrame) -> Iterator[list]:
    """Rows with a vector ``x``, in chunks of bounded size."""
    batch, size = [], 0
    for r in rows.toLocalIterator():
        batch.append(r)
        size += 8 * len(r["x"]) + 16
        if size > CHUNK_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _own_scores(rows: DataFrame, model: KernelModel) -> DataFrame:
    """``score``: the margin that each row (pair, id, sign, x) has in its own pair, from the support vectors of that pair."""
    spark, gamma = rows.sparkSession, model.gamma
    bias = F.get(F.array(*[F.lit(float(b)) for b in model.bias]), F.col("pair"))
    out = rows.select("pair", "id", "sign", "x", bias.alias("score"))
    for chunk in _chunks(model.vectors.where("alpha > 0").select("pair", (F.col("sign") * F.col("alpha")).alias("coef"), "x")):
        of = np.array([r["pair"] for r in chunk])
        shared = spark.sparkContext.broadcast((of, np.array([r["coef"] for r in chunk]), np.array([r["x"] for r in chunk], np.float32)))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of, coef, vectors = shared.value
            for b in batches:
                at = b.schema.get_field_index("score")
                x, pair = _vectors(b, "x"), b.column(b.schema.get_field_index("pair")).to_numpy()
                total = b.column(at).to_numpy().copy()
                for p in np.unique(pair):
                    mine, theirs = np.flatnonzero(pair == p), np.flatnonzero(of == p)
                    for lo in range(0, len(mine), SCORE_ROWS):
                        for there in range(0, len(theirs), SCORE_ROWS):
                            row, sv = mine[lo : lo + SCORE_ROWS], theirs[there : there + SCORE_ROWS]
                            total[row] += rbf(x[row], vectors[sv].astype(np.float64), gamma) @ coef[sv]
                yield b.set_column(at, "score", pa.array(total))

        out = out.mapInArrow(add, out.schema)
    return out


def pair_scores(df: DataFrame, model: KernelModel, features: str, keep: list[str] | None = None) -> DataFrame:
    """``scores``: one margin for each pair of classes, beside the columns ``keep`` (default: all).

    A vector that supports several pairs is compared once.
    """
    spark, gamma, n = df.sparkSession, model.gamma, len(model.pairs)
    out = df.select(*(keep or df.columns), F.col(features).alias("_x"), F.array(*[F.lit(float(b)) for b in model.bias]).alias("scores"))
    each = model.vectors.where("alpha > 0").groupBy("x", "pair").agg(F.sum(F.col("sign") * F.col("alpha")).alias("coef"))
    for chunk in _chunks(each.groupBy("x").agg(F.collect_list(F.struct("pair", "coef")).alias("of"))):  # an entry per pair
        place = [(k, o["pair"], o["coef"]) for k, r in enumerate(chunk) for o in r["of"]]
        shared = spark.sparkContext.broadcast((np.array([r["x"] for r in chunk], np.float32), place))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vectors, place = shared.value
            spread = np.zeros((len(vectors), n))
            at, pair, coef = zip(*place)
            spread[list(at), list(pair)] = coef
            for b in batches:
                old = b.schema.get_field_index("scores")
                rows = _vectors(b, "_x")
                total = b.column(old).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n).copy()
                for lo in range(0, len(rows), SCORE_ROWS):
                    for there in range(0, len(vectors), SCORE_ROWS):
                        sv = vectors[there : there + SCORE_ROWS].astype(np.float64)
                        total[lo : lo + SCORE_ROWS] += rbf(rows[lo : lo + SCORE_ROWS], sv, gamma) @ spread[there : there + SCORE_ROWS]
                ends = pa.array(np.arange(0, total.size + 1, n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:old], pa.ListArray.from_arrays(ends, pa.array(total.ravel())), *b.columns[old + 1 :]], b.schema.names)

        out = out.mapInArrow(add, out.schema)
    return out.drop("_x")


def predict_kernel(df: DataFrame, model: KernelModel, features: str, out: str = "prediction") -> DataFrame:
    """The class that wins most of its pairs; the lower class wins a tie."""
    scored = pair_scores(df, model, features)
    won = [F.when(F.get("scores", F.lit(n)) > 0, i).otherwise(j) for n, (i, j) in enumerate(model.pairs)]
    votes = F.array(*[sum((w == k).cast("int") for w in won) for k in range(len(model.classes))])
    best = F.array_position(votes, F.array_max(votes)).cast("int") - 1
    return scored.withColumn(out, F.get(F.array(*[F.lit(k) for k in model.classes]), best)).drop("scores")
