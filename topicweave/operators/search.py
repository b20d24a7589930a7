"""Choosing C: grid search, learning curve, and a population search whose candidates are scored together on Spark."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicweave.functions.fixed_values import (
    ABANDON_PROBABILITY,
    DEFAULT_SEED,
    GRID_POINTS,
    LEVY_BETA,
    LEVY_SCALE,
    LOG10_C_BOUNDS,
    N_FOLDS,
)
from topicweave.operators.curate import lookup_scores
from topicweave.operators.linear_svm import (
    EVALUATE,
    TRAIN,
    UNUSED,
    Blocks,
    LinearModel,
    fit_linear,
    pack_blocks,
    subset_scores,
)
from topicweave.operators.profile import fold_summary
from topicweave.operators.ranking import cut_points, position_bucket
from topicweave.operators.sampling import stratified_blocks, stratified_folds
from topicweave.session import staging
from topicweave.sources.models import CACHE_SCHEMA, append_cache, read_cache

KEY_PLACES = 6


def grid_values(lo: float = LOG10_C_BOUNDS[0], hi: float = LOG10_C_BOUNDS[1], points: int = GRID_POINTS) -> list[float]:
    return [10.0 ** (lo + i * (hi - lo) / (points - 1)) for i in range(points)]


def fold_roles(folds: int = N_FOLDS, fold: str = "fold") -> list[Column]:
    return [F.when(F.col(fold) == i, EVALUATE).otherwise(TRAIN) for i in range(folds)]


def pack_folds(
    df: DataFrame, features: str, label: str, row_id: str, folds: int = N_FOLDS, seed: int = DEFAULT_SEED, with_full: bool = False
) -> Blocks:
    """Blocks with one training set per random stratified fold, and optionally one that trains on everything."""
    folded = stratified_folds(df, label, row_id, folds, seed)
    return pack_blocks(folded, features, label, row_id, fold_roles(folds) + ([F.lit(TRAIN)] if with_full else []))


def cross_validate(
    blocks: Blocks, c_values: Sequence[float], folds: int = N_FOLDS, subsets: Sequence[int] | None = None, tol: float = 1e-4
):
    """All (C, fold) models in one batch. Returns the models and the table (subset, c, role, macro_f1)."""
    models = fit_linear(blocks, c_values, subsets=subsets, tol=tol)
    return models, subset_scores(blocks, models)


@dataclass
class GridResult:
    scores: DataFrame  # c, fold, train_f1, test_f1
    curve: DataFrame  # c, mean_score, std_score, lower, upper, is_best
    best_c: float
    best_score: float
    model: LinearModel


def validation_curve(cv: DataFrame) -> DataFrame:
    """Mean, and mean -/+ standard deviation, of the test score by C; the best mean is marked (smallest C on ties).

    The table has one row per candidate, so ordering it in one task is bounded by the number of candidates.
    """
    stats = fold_summary(cv, ["c"], "test_f1").withColumn("_all", F.lit(0))
    best = F.row_number().over(Window.partitionBy("_all").orderBy(F.desc("mean_score"), "c")) == 1
    return stats.select(
        "c", "mean_score", "std_score", (F.col("mean_score") - F.col("std_score")).alias("lower"),
        (F.col("mean_score") + F.col("std_score")).alias("upper"), best.alias("is_best"),
    ).orderBy("c")


def grid_search(
    df: DataFrame, features: str, label: str, row_id: str, c_values: Sequence[float] | None = None,
    folds: int = N_FOLDS, seed: int = DEFAULT_SEED, tol: float = 1e-4,
) -> GridResult:
    """Cross-validated macro F1 of every C, and the model of the best C trained on all rows.

    The refits ride along in the same passes as one more training set.
    """
    c_values = list(c_values or grid_values())
    with staging(df.sparkSession):
        blocks = pack_folds(df, features, label, row_id, folds, seed, with_full=True)
        try:
            models, table = cross_validate(blocks, c_values, folds, tol=tol)
            local = table.where(F.col("subset") < folds).toArrow()  # candidates x folds x 2 rows
        finally:
            blocks.close()
    scored = df.sparkSession.createDataFrame(local, schema=table.schema)
    cv = scored.groupBy("c", F.col("subset").alias("fold")).agg(
        F.max(F.when(F.col("role") == TRAIN, F.col("macro_f1"))).alias("train_f1"),
        F.max(F.when(F.col("role") == EVALUATE, F.col("macro_f1"))).alias("test_f1"),
    )
    curve = validation_curve(cv)
    best = curve.where("is_best").first()
    index = min(range(len(c_values)), key=lambda i: abs(c_values[i] - best["c"]))
    return GridResult(cv, curve, best["c"], best["mean_score"], models[folds, index])


def learning_curve(
    df: DataFrame, features: str, label: str, pos: str, fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    c: float = 1.0, folds: int = N_FOLDS, tol: float = 1e-4,
) -> DataFrame:
    """Train and held-out macro F1 (mean, standard deviation over folds) for growing prefixes of the training rows.

    Sizes are fractions of the first fold's training set. The end of each prefix is an exact cut position; with the
    cuts known, all (fold, size) models train in one batch. A prefix that holds a single class trains no model; a size
    without any model has null scores.
    """
    spark = df.sparkSession
    folded = stratified_blocks(df, label, pos, folds)
    in_first = folded.where(F.col("fold") != 0).count()
    sizes = sorted({min(max(int(f * in_first), 1), in_first) for f in fractions})
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("fold"))
    training = folded.select(pos, F.explode(others).alias("train_of")).withColumn("_bucket", position_bucket(df, pos))
    wanted = [(f, i, n) for f in range(folds) for i, n in enumerate(sizes)]
    quotas = spark.createDataFrame(wanted, "train_of int, size_id int, quota bigint")
    cuts = cut_points(training, ["train_of"], "_bucket", [pos], quotas).collect()  # folds x sizes rows
    cut_of = {(r["train_of"], r["size_id"]): r[f"cut_{pos}"] for r in cuts}
    roles, subset_of = [], []
    for f, i, n in wanted:
        cut = cut_of[f, i]
        inside = (F.col("fold") != f) if cut is None else (F.col("fold") != f) & (F.col(pos) <= F.lit(cut))
        roles.append(F.when(F.col("fold") == f, EVALUATE).when(inside, TRAIN).otherwise(UNUSED))
        subset_of.append(n)
    with staging(spark):
        blocks = pack_blocks(folded, features, label, pos, roles)
        try:
            able = [s for s in range(len(roles)) if (blocks.counts[s] > 0).sum() > 1]
            table = subset_scores(blocks, fit_linear(blocks, [c], subsets=able, tol=tol))
            local = table.toArrow()
        finally:
            blocks.close()
    rows = spark.createDataFrame(local, schema=table.schema)
    unable = [(s, None, TRAIN, None) for s in range(len(roles)) if s not in able]
    if unable:
        rows = rows.unionByName(spark.createDataFrame(unable, "subset int, c double, role int, macro_f1 double"))
    size = F.get(F.array(*[F.lit(n) for n in subset_of]), F.col("subset"))
    out = rows.groupBy(size.alias("n_train"))
    train, test = (F.when(F.col("role") == r, F.col("macro_f1")) for r in (TRAIN, EVALUATE))
    return out.agg(
        F.avg(train).alias("train_mean"), F.stddev_pop(train).alias("train_std"),
        F.avg(test).alias("test_mean"), F.stddev_pop(test).alias("test_std"),
    ).orderBy("n_train")


def score_candidates(
    spark: SparkSession, blocks: Blocks, log_cs: Sequence[float], cache_path: str, folds: int = N_FOLDS,
    model: str = "linear_svc", metric: str = "f1_macro", tol: float = 1e-4,
) -> dict[float, float]:
    """Mean held-out macro F1 for each log10 C. Values known to the cache table (by log10 C to six places) are looked
    up; all others are trained in one batch and appended to it."""
    first = {}
    for x in log_cs:
        first.setdefault(round(float(x), KEY_PLACES), float(x))
    wanted = spark.createDataFrame(
        [(model, metric, f"{k:.{KEY_PLACES}f}") for k in first], "model string, metric string, k string"
    ).select("model", "metric", F.col("k").cast("decimal(10,6)").alias("log_c"))
    known, missing = lookup_scores(wanted, read_cache(spark, cache_path), ["model", "metric", "log_c"])
    scores = {float(r["log_c"]): r["score"] for r in known.collect()}
    todo = [float(r["log_c"]) for r in missing.collect()]
    if todo:
        cs = [10.0 ** first[k] for k in todo]
        _, table = cross_validate(blocks, cs, folds, range(folds), tol)
        held = table.where((F.col("role") == EVALUATE) & (F.col("subset") < folds))
        means = {r["c"]: r["s"] for r in held.groupBy("c").agg(F.avg("macro_f1").alias("s")).collect()}
        new = [(model, metric, f"{k:.{KEY_PLACES}f}", means[c]) for k, c in zip(todo, cs)]
        frame = spark.createDataFrame(new, "model string, metric string, k string, score double").select(
            "model", "metric", F.col("k").cast("decimal(10,6)").alias("log_c"), "score"
        )
        append_cache(frame.select(*[f.name for f in CACHE_SCHEMA.fields]), cache_path)
        scores.update({k: means[c] for k, c in zip(todo, cs)})
    return {float(x): scores[round(float(x), KEY_PLACES)] for x in log_cs}


# --- population search -----------------------------------------------------------------------------------------------


@dataclass
class SearchResult:
    best: list[float]
    best_score: float
    trace: DataFrame  # generation, best, score
    evaluations: int = 0
    population: np.ndarray = field(default=None)


def levy_sigma(beta: float = LEVY_BETA) -> float:
    """Spread of the numerator of a Levy step drawn by Mantegna's method."""
    top = math.gamma(1 + beta) * math.sin(math.pi * beta / 2)
    return (top / (math.gamma((1 + beta) / 2) * beta * 2 ** ((beta - 1) / 2))) ** (1 / beta)


STATE_SCHEMA = "nest int, x array<double>, score double, run string, asked array<array<double>>"


def point_key(point: Sequence[float]) -> tuple[float, ...]:
    """Points that agree to so many places are one evaluation."""
    return tuple(round(float(v), KEY_PLACES) for v in point)


def _load_state(spark: SparkSession, path: str, generations: int, run: str):
    """The last finished generation under ``path``, if any. A generation is one file, which appears when it is whole."""
    try:
        rows = spark.read.schema(STATE_SCHEMA + ", generation int").parquet(path).where(F.col("generation") <= generations).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not rows:
        return None
    if any(r["run"] != run for r in rows):
        raise ValueError(f"{path} holds the state of a search with other settings or data")
    last = max(r["generation"] for r in rows)
    rows = sorted((r for r in rows if r["generation"] == last), key=lambda r: r["nest"])
    return last, np.array([r["x"] for r in rows]), np.array([r["score"] for r in rows]), rows[0]["asked"]


def population_search(
    spark: SparkSession,
    score_all: Callable[[DataFrame], DataFrame],
    dims: int,
    state_path: str,
    population: int = 150,
    generations: int = 300,
    bounds: Sequence[tuple[float, float]] | None = None,
    abandon: float = ABANDON_PROBABILITY,
    beta: float = LEVY_BETA,
    minimise: bool = True,
    seed: int = DEFAULT_SEED,
    run_key: str = "",
) -> SearchResult:
    """Cuckoo search (Yang and Deb, "Cuckoo search via Levy flights", 2009) over batches of candidates.

    ``score_all`` maps a candidate table (nest, x) to a score table (nest, score): the Spark job. A generation asks
    for two batches: Levy steps away from the best nest, and partial rebuilding of nests from differences of two
    others. A nest takes its proposal unless that is worse. Proposals are kept within bounds before they are scored,
    and the best nest is read off after the last step. Every generation is written to ``state_path``; a restarted
    search continues after the last finished one with the same random numbers. The state names the settings it belongs
    to, with ``run_key`` for the data; under other settings it is refused. Distinct points are counted over the whole run.
    """
    sign = 1.0 if minimise else -1.0
    lows, highs = (np.array(v, dtype=float) for v in zip(*bounds)) if bounds else (-np.inf, np.inf)
    run = {"dims": dims, "population": population, "bounds": bounds, "abandon": abandon, "beta": beta, "minimise": minimise, "seed": seed}
    own = hashlib.sha256(json.dumps([run, run_key], sort_keys=True, default=list).encode()).hexdigest()
    asked: set[tuple] = set()

    def costs(points: np.ndarray) -> np.ndarray:
        asked.update(point_key(p) for p in points)
        table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "nest int, x array<double>")
        out = np.empty(len(points))
        for r in score_all(table).select("nest", "score").collect():
            out[r["nest"]] = sign * r["score"]
        return out

    def save(g: int, nests: np.ndarray, cost: np.ndarray) -> None:
        rows = [(i, x.tolist(), float(sign * c), own, None) for i, (x, c) in enumerate(zip(nests, cost))]
        rows[0] = (*rows[0][:4], sorted(map(list, asked)))  # every point asked for so far
        spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/generation={g}")

    found = _load_state(spark, state_path, generations, own)
    if found:
        done, nests, cost = found[0], found[1], sign * found[2]
        asked.update(tuple(p) for p in found[3])
    else:
        rng = np.random.default_rng([seed, 0])
        drawn = rng.random((population, dims)) * (highs - lows) + lows if bounds else rng.standard_normal((population, dims))
        done, nests = 0, drawn
        cost = costs(nests)
        save(0, nests, cost)
    for g in range(done + 1, generations + 1):
        rng = np.random.default_rng([seed, g])
        best = nests[cost.argmin()]
        levy = rng.normal(0.0, levy_sigma(beta), dims) / np.abs(rng.standard_normal(dims)) ** (1 / beta)
        flights = rng.standard_normal(nests.shape) * LEVY_SCALE * levy * (nests - best)
        for make in (
            lambda: flights,
            lambda: (rng.random(nests.shape) < abandon)
            * rng.random(nests.shape)
            * (nests[rng.integers(0, len(nests), len(nests))] - nests[rng.integers(0, len(nests), len(nests))]),
        ):
            proposal = np.clip(nests + make(), lows, highs)
            proposed = costs(proposal)
            take = proposed <= cost
            nests, cost = np.where(take[:, None], proposal, nests), np.where(take, proposed, cost)
        save(g, nests, cost)
    top = cost.argmin()
    saved = spark.read.schema(STATE_SCHEMA + ", generation int").parquet(state_path)
    pick = F.min_by if minimise else F.max_by
    value = F.min("score") if minimise else F.max("score")
    trace = saved.groupBy("generation").agg(pick("x", "score").alias("best"), value.alias("score")).orderBy("generation")
    return SearchResult(nests[top].tolist(), float(sign * cost[top]), trace, len(asked), nests)


def search_c(
    df: DataFrame, features: str, label: str, row_id: str, work_path: str, population: int = 6, generations: int = 2,
    folds: int = N_FOLDS, seed: int = DEFAULT_SEED,
) -> tuple[SearchResult, LinearModel]:
    """Population search for log10 C by cross-validated macro F1, then the model of the best C on all rows."""
    spark = df.sparkSession
    blocks = pack_folds(df, features, label, row_id, folds, seed, with_full=True)
    try:

        def score_all(table: DataFrame) -> DataFrame:
            asked = {r["nest"]: r["x"][0] for r in table.collect()}
            got = score_candidates(spark, blocks, list(asked.values()), f"{work_path}/cache", folds)
            return spark.createDataFrame([(n, got[float(x)]) for n, x in asked.items()], "nest int, score double")

        result = population_search(
            spark, score_all, 1, f"{work_path}/state", population, generations, [LOG10_C_BOUNDS], minimise=False, seed=seed,
            run_key=json.dumps([[str(c) for c in blocks.classes], blocks.counts.tolist(), blocks.dim, folds]),
        )
        # the set that trains on everything has been packed along
        return result, fit_linear(blocks, [10.0 ** result.best[0]], subsets=[folds])[folds, 0]
    finally:
        blocks.close()


def population_fitness(df: DataFrame, losses: dict[int, Column]) -> DataFrame:
    """Mean loss of every candidate over a table in one scan: one aggregate per candidate, then one row each.

    The candidates are expressions, so the table is neither copied nor joined.
    """
    one = df.agg(*[F.avg(loss).alias(f"c{i}") for i, loss in losses.items()])
    rows = F.array(*[F.struct(F.lit(i).alias("nest"), F.col(f"c{i}").alias("mean_loss")) for i in losses])
    return one.select(F.inline(rows))
