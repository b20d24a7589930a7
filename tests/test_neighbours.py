"""Neighbour lists against brute force, and the map that is made from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.operators import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24)) * 4
    x = np.concatenate([c + rng.normal(size=(100, 24)) for c in centres]).astype(np.float32)
    rows = [(i, v.tolist(), i // 100) for i, v in enumerate(x)]
    return x.astype(float), spark.createDataFrame(rows, SCHEMA).cache()


def test_lists(spark, blobs):
    x, df = blobs
    graph = nb.neighbour_graph(df, "embedding", "vec_id", k=10, trees=3, leaf=32)
    rows = graph.collect()
    truth = brute(x, 10)
    per = {}
    for r in rows:
        assert r.src != r.dst
        assert abs(r.dist - ((x[r.src] - x[r.dst]) ** 2).sum()) < 1e-6
        per.setdefault(r.src, []).append(r.dist)
    assert len({(r.src, r.dst) for r in rows}) == len(rows) == 10 * len(x)
    hits = sum(sum(v <= truth[i][-1] * (1 + 1e-9) for v in per[i]) for i in range(len(x)))
    share = hits / (10 * len(x))
    assert share >= 0.9
    asked = F.col("vec_id") % 10 == 0
    own = sum(sum(v <= truth[i][-1] * (1 + 1e-9) for v in per[i]) for i in range(0, len(x), 10)) / len(x)
    assert nb.recall(graph, df, "embedding", "vec_id", asked, 10) == pytest.approx(own, abs=1e-9)


def test_equal_vectors_fill_no_leaf(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i), 0.0], 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    slim = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    leaves = nb.tree_leaves(slim, 2, 2, 16)
    assert leaves.groupBy("tree", "node").count().agg(F.max("count")).first()[0] <= 16
    assert leaves.count() == 1200
    graph = nb.neighbour_graph(df, "embedding", "vec_id", k=5, trees=2, leaf=16)
    assert graph.where("src % 3 <> 0").agg(F.max("dist")).first()[0] == 0
    assert graph.groupBy("dst").count().agg(F.max("count")).first()[0] < 60


def test_map_separates_groups(spark, blobs):
    _, df = blobs
    points = nb.neighbour_map(df, "embedding", "vec_id", k=10, trees=3, leaf=32).join(df, "vec_id").collect()
    assert len(points) == 600
    at = {}
    for r in points:
        assert np.isfinite([r.x, r.y]).all()
        at.setdefault(r.label, []).append((r.x, r.y))
    inside = np.mean([np.var(v, axis=0).sum() for v in at.values()])
    between = np.var([np.mean(v, axis=0) for v in at.values()], axis=0).sum()
    assert between > inside


def test_small_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nb.neighbour_graph(none, "embedding", "vec_id").count() == 0
    assert nb.neighbour_map(none, "embedding", "vec_id").count() == 0
    few = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, None, 0), (3, [1.0, 1.0], 0), (4, [3.0, 1.0], 0)], SCHEMA)
    lists = {(r.src, r.dst): r.dist for r in nb.neighbour_graph(few, "embedding", "vec_id").collect()}
    assert lists == {(1, 3): 1, (3, 1): 1, (1, 4): 9, (4, 1): 9, (3, 4): 4, (4, 3): 4}
    assert nb.neighbour_map(few, "embedding", "vec_id").count() == 3


def test_meetings_give_their_edges_in_slices(monkeypatch):
    """What a task holds at once follows the slice, not the number of meetings in a batch."""
    import pyarrow as pa

    from topicweave.operators import neighbours

    rng = np.random.default_rng(0)
    guests = [[{"id": int(i), "vec": rng.normal(size=8).tolist()} for i in range(61)] for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(guests)], ["guests"])
    parts = [b.num_rows for b in neighbours._meet(iter([batch]), 30)]
    assert sum(parts) == 2000 * 61 * 30 and max(parts) * 24 <= neighbours.SLICE_BYTES and len(parts) > 1


def test_batches_are_small_while_the_lists_are_mended(spark, monkeypatch):
    from topicweave.operators import neighbours

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, descend = spark.conf.get(key), [], neighbours._descend
    monkeypatch.setattr(neighbours, "_descend", lambda *a: (seen.append(int(spark.conf.get(key))), descend(*a))[1])
    rows = [(i, [float(i % 7), float(i)]) for i in range(60)]
    neighbours.neighbour_graph(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id", 3).collect()
    assert seen and max(seen) == neighbours.BATCH_ROWS and spark.conf.get(key) == before
