"""The cascade against one plain solver over all rows."""

import numpy as np
import pytest

from topicweave.operators import kernel_svm as ks


def plain(x, sign, cost, gamma):
    """Dual problem by projected coordinate pairs, in turn over all pairs of a random order, until nothing moves."""
    rng, k = np.random.default_rng(0), ks.rbf(x, x, gamma)
    alpha, n = np.zeros(len(sign)), len(sign)
    for _ in range(400):
        moved = 0.0
        order = rng.permutation(n)
        for i, j in zip(order, np.roll(order, 1)):
            for a, b in ((i, j), (int(np.argmax(_slope(alpha, sign, k, cost, 1))), int(np.argmin(_slope(alpha, sign, k, cost, -1))))):
                e = k @ (alpha * sign) - sign
                step = (e[b] - e[a]) / max(2 - 2 * k[a, b], 1e-12)
                low = max(-alpha[a] if sign[a] > 0 else alpha[a] - cost[a], alpha[b] - cost[b] if sign[b] > 0 else -alpha[b])
                high = min(cost[a] - alpha[a] if sign[a] > 0 else alpha[a], alpha[b] if sign[b] > 0 else cost[b] - alpha[b])
                step = min(max(step, low), high)
                alpha[a] += sign[a] * step
                alpha[b] -= sign[b] * step
                moved = max(moved, abs(step))
        if moved < 1e-9:
            break
    up, down = _slope(alpha, sign, k, cost, 1).max(), _slope(alpha, sign, k, cost, -1).min()
    return alpha, (up + down) / 2


def _slope(alpha, sign, k, cost, way):
    e = sign - k @ (alpha * sign)
    up = np.where(sign > 0, alpha < cost - 1e-12, alpha > 1e-12)
    down = np.where(sign > 0, alpha > 1e-12, alpha < cost - 1e-12)
    return np.where(up, e, -np.inf) if way > 0 else np.where(down, e, np.inf)


def points(n=90, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    return rng.normal(size=(n, 2)) + np.array([(0, 0), (2, 0.5), (0.5, 2)])[label], label


@pytest.mark.parametrize(("part_rows", "balanced"), [(1000, False), (8, True)])
def test_margins_equal_a_plain_solver(spark, monkeypatch, part_rows, balanced):
    monkeypatch.setattr(ks, "PART_ROWS", part_rows)
    x, label = points()
    x = x.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label))], "id long, x array<float>, y int")
    model = ks.fit_kernel(frame, "x", "y", "id", c=2.0, gamma=0.7, tol=1e-5, balanced=balanced)
    assert model.converged and model.classes == [0, 1, 2]
    got = np.array([r["scores"] for r in ks.pair_scores(frame, model, "x").orderBy("id").collect()])
    for n, (i, j) in enumerate(model.pairs):
        mine = (label == i) | (label == j)
        sign = np.where(label[mine] == i, 1.0, -1.0)
        weight = [len(label) / (3 * (label == k).sum()) if balanced else 1.0 for k in (i, j)]
        cost = 2.0 * np.where(sign > 0, *weight)
        alpha, bias = plain(x[mine], sign, cost, 0.7)
        want = ks.rbf(x, x[mine], 0.7) @ (alpha * sign) + bias
        assert np.abs(got[:, n] - want).max() < 2e-3
    said = np.array([r["prediction"] for r in ks.predict_kernel(frame, model, "x").orderBy("id").collect()])
    votes = np.zeros((len(label), 3), int)
    for n, (i, j) in enumerate(model.pairs):
        votes[np.arange(len(label)), np.where(got[:, n] > 0, i, j)] += 1
    assert (said == votes.argmax(axis=1)).all() and (said == label).mean() > 0.6
    monkeypatch.setattr(ks, "CHUNK_BYTES", 200)
    again = np.array([r["scores"] for r in ks.pair_scores(frame, model, "x").orderBy("id").collect()])
    assert np.allclose(again, got)


def test_labels_are_needed(spark):
    for rows in ([(1, [1.0], None), (2, [1.0], 1)], [(1, [1.0], 1)]):
        with pytest.raises(ValueError):
            ks.fit_kernel(spark.createDataFrame(rows, "id long, x array<float>, y int"), "x", "y", "id")


def test_solver_goes_on_from_the_parts(monkeypatch):
    """Dual variables of two solved parts are a start for all rows: fewer steps, the same solution; a solution needs none."""
    x, label = points(400)
    sign, cost = np.where(label == 0, 1.0, -1.0), np.ones(400)
    seen, row = [], ks._Rows.__getitem__
    monkeypatch.setattr(ks._Rows, "__getitem__", lambda self, i: (seen.append(i), row(self, i))[1])

    def steps(start):
        seen.clear()
        return *ks.solve(x, sign, cost, 0.7, 1e-5, start), len(seen)

    alpha, bias, cold = steps(None)
    start = np.zeros(400)
    for part in (slice(0, 200), slice(200, 400)):
        start[part] = ks.solve(x[part], sign[part], cost[part], 0.7, 1e-5)[0]
    again, same, warm = steps(start)
    assert 0 < warm < cold and abs(same - bias) < 1e-4 and np.abs(ks.rbf(x, x, 0.7) @ (sign * (alpha - again))).max() < 1e-3
    assert steps(alpha)[2] == 0


def test_own_scores_are_those_of_the_pair(spark, monkeypatch):
    monkeypatch.setattr(ks, "PART_ROWS", 8)
    x, label = points()
    frame = spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label))], "id long, x array<float>, y int")
    model = ks.fit_kernel(frame, "x", "y", "id", c=2.0, gamma=0.7)
    every = {r["id"]: r["scores"] for r in ks.pair_scores(frame, model, "x").collect()}
    asked = [(n, i, 1.0, [float(v) for v in r]) for n in range(3) for i, r in enumerate(x)]
    for size in (ks.CHUNK_BYTES, 200):
        monkeypatch.setattr(ks, "CHUNK_BYTES", size)
        got = ks._own_scores(spark.createDataFrame(asked, "pair int, id long, sign double, x array<float>"), model).collect()
        assert len(got) == len(asked) and all(abs(r["score"] - every[r["id"]][r["pair"]]) < 1e-9 for r in got)


@pytest.mark.parametrize("block", [4, 64, 1024])
def test_solver_takes_blocks_of_rows(monkeypatch, block):
    """Kernel rows are asked for many at once, and the solution keeps to the bounds, the constraint and the tolerance."""
    x, label = points(300)
    sign, cost = np.where(label == 0, 1.0, -1.0), np.where(label == 0, 1.5, 0.5)
    asked, rows = [], ks._Rows.__getitem__
    monkeypatch.setattr(ks, "BLOCK_ROWS", block)
    monkeypatch.setattr(ks, "CACHE_ROWS", 40)
    monkeypatch.setattr(ks._Rows, "__getitem__", lambda self, some: (asked.append(some.size), rows(self, some))[1])
    alpha, bias = ks.solve(x, sign, cost, 0.7, 1e-4)
    assert max(asked) <= block and (block < 64 or len(asked) < 60)
    assert (alpha >= 0).all() and (alpha <= cost).all() and abs(sign @ alpha) < 1e-9
    k = ks.rbf(x, x, 0.7)
    up, down = _slope(alpha, sign, k, cost, 1).max(), _slope(alpha, sign, k, cost, -1).min()
    assert up - down < 1e-4 + 1e-9 and abs((up + down) / 2 - bias) < 1e-6
