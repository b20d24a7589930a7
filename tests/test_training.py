import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.operators import calibrate, search
from topicweave.operators import linear_svm as ls
from topicweave.plans import jobs
from topicweave.session import scratch_path
from topicweave.sources import models as store


def points(spark, n=60, k=3, d=2, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % k
    x = (rng.normal(size=(k, d))[y] * 2 + spread * rng.normal(size=(n, d))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id bigint, x array<float>, y int")
    return df, np.hstack([x, np.ones((n, 1))]).astype(float), y


def dense(x, s, cost):
    w = np.zeros(x.shape[1])
    obj = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - s * (x @ v)) ** 2).sum()
    for _ in range(200):
        z = np.maximum(0, 1 - s * (x @ w))
        on = z > 0
        g = w - 2 * x.T @ (cost * s * z)
        step = np.linalg.solve(np.eye(len(w)) + 2 * (x[on].T * cost[on]) @ x[on], g)
        t = 1.0
        while obj(w - t * step) > obj(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return w


@pytest.mark.parametrize("curvature", [0, 8 << 20])
@pytest.mark.parametrize("k", [2, 3])
def test_weights_equal_a_dense_solve(spark, monkeypatch, k, curvature):
    monkeypatch.setattr(ls, "CURVATURE_BYTES", curvature)
    df, x, y = points(spark, k=k)
    blocks = ls.pack_blocks(df.where("id < 59"), "x", "y", "id")
    got = ls.fit_linear(blocks, [0.5, 20.0], tol=1e-8)
    x, y = x[:59], y[:59]
    n_c = np.bincount(y)
    weight = len(y) / (k * n_c)
    for ci, c in enumerate((0.5, 20.0)):
        for cls in range(k):
            s = np.where(y == cls, 1.0, -1.0)
            other = weight[1 - cls] if k == 2 else 1.0
            want = dense(x, s, c * np.where(y == cls, weight[cls], other))
            assert np.abs(got[0, ci].weights[cls] - want).max() < 1e-4


def test_gradient_and_curvature_by_differences(spark):
    df, _, _ = points(spark, n=30)
    blocks = ls.pack_blocks(df, "x", "y", "id")
    w = np.random.default_rng(2).normal(size=(1, 3)) * 0.3
    args = (np.array([1]), np.array([0]), np.array([2.0]), np.array([1.0]))
    _, g, h = ls._loss_and_gradient(blocks, w, *args, curvature=True)
    for j in range(3):
        e = np.zeros((1, 3))
        e[0, j] = 1e-6
        (up, gu, _), (down, gd, _) = (ls._loss_and_gradient(blocks, w + s * e, *args) for s in (1, -1))
        assert (up - down)[0] / 2e-6 == pytest.approx(g[0, j], rel=1e-4)
        assert np.abs((gu - gd)[0] / 2e-6 - h[0, j]).max() < 1e-3


def test_sums_through_a_shuffle_are_the_same(spark, monkeypatch):
    df, _, _ = points(spark, n=50)
    blocks = ls.pack_blocks(df, "x", "y", "id")
    a = ls.fit_linear(blocks, [1.0], tol=1e-8)[0, 0].weights
    monkeypatch.setattr(ls, "DRIVER_BYTES", 0)
    assert np.abs(ls.fit_linear(blocks, [1.0], tol=1e-8)[0, 0].weights - a).max() < 1e-6


def test_class_missing_from_a_subset_is_never_predicted(spark):
    df, _, _ = points(spark, n=60, k=3)
    role = F.when(F.col("y") == 2, ls.EVALUATE).otherwise(ls.TRAIN)
    model = ls.fit_linear(ls.pack_blocks(df, "x", "y", "id", [role]), [1.0])[0, 0]
    seen = {r["prediction"] for r in ls.predict(df, model, "x").collect()}
    assert seen <= {0, 1}
    with pytest.raises(ValueError):
        ls.pack_blocks(df.where("y = 1"), "x", "y", "id")


def test_model_round_trip(spark):
    df, _, _ = points(spark)
    model = jobs.train_linear(df, "x", "y", "id")
    path = scratch_path(spark, "model")
    store.save_model(model, spark, path)
    again = store.load_model(spark, path)
    assert np.array_equal(again.weights, model.weights) and again.classes == model.classes
    report = jobs.score_dataset(df, again, "x", "y")
    assert report.accuracy.first()[0] > 0.6 and report.confusion.count() == 9


def test_calibration(spark):
    df, x, y = points(spark, n=150, spread=2.0)
    model = calibrate.fit_calibrated(df, "x", "y", "id")
    rows = calibrate.predict_proba(df, model, "x").orderBy("id").collect()
    p = np.array([r["probs"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.5
    path = scratch_path(spark, "calibrated")
    store.save_calibrated(model, spark, path)
    again = calibrate.predict_proba(df, store.load_calibrated(spark, path), "x").orderBy("id").collect()
    assert np.allclose([r["probs"] for r in again], p)


def test_sigmoid_equals_a_dense_fit(spark):
    rng = np.random.default_rng(4)
    s = rng.normal(size=200)
    pos = rng.random(200) < 1 / (1 + np.exp(-2 * s + 0.5))
    df = spark.createDataFrame([(0, float(v), bool(t)) for v, t in zip(s, pos)], "group int, score double, is_pos boolean")
    a, b = calibrate.fit_sigmoids(df, 1)
    t = np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
    p = 1 / (1 + np.exp(a[0] * s + b[0]))
    assert abs(((t - p) * s).sum()) < 1e-3 and abs((t - p).sum()) < 1e-3


def test_binary_calibration_sums_to_one(spark):
    df, _, _ = points(spark, n=60, k=2)
    model = calibrate.fit_calibrated(df, "x", "y", "id")
    for r in calibrate.predict_proba(df, model, "x").collect():
        assert sum(r["probs"]) == pytest.approx(1)


def test_grid_search_and_learning_curve(spark):
    df, _, _ = points(spark, n=90, spread=1.5)
    got = search.grid_search(df, "x", "y", "id", [0.01, 1.0, 100.0])
    curve = got.curve.collect()
    assert [r["c"] for r in curve] == [0.01, 1.0, 100.0] and sum(r["is_best"] for r in curve) == 1
    assert got.best_score == max(r["mean_score"] for r in curve) and got.model.c == got.best_c
    assert got.scores.count() == 15
    sizes = search.learning_curve(df, "x", "y", "id", (0.5, 1.0)).collect()
    assert [r["n_train"] for r in sizes] == [36, 72]
    assert sizes[1]["test_std"] >= 0 and 0 < sizes[1]["test_mean"] <= 1


def test_cached_scores_are_not_trained_again(spark, monkeypatch):
    df, _, _ = points(spark, n=60)
    blocks = search.pack_folds(df, "x", "y", "id")
    path = scratch_path(spark, "cache")
    first = search.score_candidates(spark, blocks, [0.0, 1.0, 1.0000000001], path)
    assert store.read_cache(spark, path).count() == 2 and first[1.0] == first[1.0000000001]
    monkeypatch.setattr(search, "cross_validate", lambda *a: pytest.fail("trained again"))
    assert search.score_candidates(spark, blocks, [1.0, 0.0], path) == {0.0: first[0.0], 1.0: first[1.0]}


def bowl(spark, calls):
    def score(table):
        calls.append(table.count())
        return table.select("nest", F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - 1) * (v - 1)).alias("score"))

    return score


def test_population_search_improves_and_restarts(spark):
    path, calls = scratch_path(spark, "search"), []
    args = dict(dims=2, state_path=path, population=8, bounds=[(-5.0, 5.0)] * 2)
    first = search.population_search(spark, bowl(spark, calls), generations=3, **args)
    trace = [r["score"] for r in first.trace.collect()]
    assert len(trace) == 4 and trace == sorted(trace, reverse=True) and first.best_score == trace[-1]
    assert all(-5 <= v <= 5 for v in first.best)
    asked = len(calls)
    more = search.population_search(spark, bowl(spark, calls), generations=4, **args)
    assert len(calls) == asked + 2 and more.best_score <= first.best_score
    whole = search.population_search(spark, bowl(spark, []), generations=4, **{**args, "state_path": scratch_path(spark, "search")})
    assert whole.best == more.best


def test_search_for_c(spark):
    df, _, _ = points(spark, n=60)
    result, model = search.search_c(df, "x", "y", "id", scratch_path(spark, "c"), population=3, generations=1)
    assert model.c == pytest.approx(10 ** result.best[0]) and -2 <= result.best[0] <= 4
    summary = store.run_summary(spark, result.best[0], 0.5, result.best_score, 3, 1, result.evaluations)
    assert summary.first()["budget"]["evaluations"] == result.evaluations
    path = scratch_path(spark, "summary")
    store.save_summary(summary, path)
    assert spark.read.json(path).count() == 1


def test_levy_sigma():
    assert search.levy_sigma() == pytest.approx(0.6966, abs=1e-4)


def test_rows_without_a_label_are_refused(spark):
    df, _, _ = points(spark)
    with pytest.raises(ValueError, match="without a label"):
        ls.pack_blocks(df.withColumn("y", F.when(F.col("id") % 5 > 0, F.col("y"))), "x", "y", "id")


def test_a_fit_that_stops_early_says_so(spark):
    df, _, _ = points(spark)
    blocks = ls.pack_blocks(df, "x", "y", "id")
    with pytest.warns(UserWarning, match="stopped above"):
        short = ls.fit_linear(blocks, [100.0], tol=1e-12, max_passes=2)[0, 0]
    assert not short.converged and short.gradient > 1e-12
    assert ls.fit_linear(blocks, [1.0])[0, 0].converged
    flat = spark.createDataFrame([(0, float(i % 7), i % 2 == 0) for i in range(40)], "group int, score double, is_pos boolean")
    with pytest.warns(UserWarning, match="not settled"):
        calibrate.fit_sigmoids(flat, 1, max_steps=1, tol=0.0)


def test_distinct_evaluations_are_counted_over_restarts(spark):
    seen = set()

    def score(table):
        seen.update(search.point_key(r["x"]) for r in table.collect())
        return bowl(spark, [])(table)

    path = scratch_path(spark, "search")
    args = dict(dims=1, state_path=path, population=6, bounds=[(-1.0, 1.0)])
    search.population_search(spark, score, generations=2, **args)
    more = search.population_search(spark, score, generations=4, **args)
    assert more.evaluations == len(seen)


def test_state_of_another_search_is_refused(spark):
    path = scratch_path(spark, "search")
    args = dict(dims=1, state_path=path, population=4, bounds=[(-1.0, 1.0)], generations=1)
    search.population_search(spark, bowl(spark, []), **args)
    for other in ({"seed": 7}, {"population": 5}, {"bounds": [(-2.0, 1.0)]}, {"run_key": "other rows"}):
        with pytest.raises(ValueError, match="other settings"):
            search.population_search(spark, bowl(spark, []), **{**args, **other})


def test_a_prefix_with_one_class_has_no_score(spark):
    rows = [(i, [float(i % 30 + 40 * (i >= 60)), 1.0], int(i >= 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, x array<float>, y int")
    got = search.learning_curve(df, "x", "y", "id", (0.2, 1.0)).collect()
    assert got[0]["test_mean"] is None and got[1]["test_mean"] > 0.5


def test_encoder_remembers_a_bounded_number_of_words():
    from topicweave.operators import features

    encoder, texts = features.HashedEncoder(), [" ".join(f"w{i}" for i in range(k, k + 50_000)) for k in (0, 50_000)]
    first, again = encoder(texts), encoder(texts)
    assert len(encoder.seen) <= 1 << 16 and (first == again).all()
