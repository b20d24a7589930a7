"""Functions per group, step reports, elements of pages, the end of a search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.functions.html import element_texts
from topicweave.operators import extract
from topicweave.operators.groups import least, per_group
from topicweave.operators.linear_svm import LinearModel
from topicweave.operators.profile import StepReport
from topicweave.plans import jobs
from topicweave.sources.models import load_model


@pytest.mark.parametrize("combine", [False, True])
def test_least_of_each_group(spark, combine):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 5}", (i * 7919) % 1009) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(6)
    got = {(r.k, r.id) for r in per_group(df, ["k"], least(4, ["v", "id"]), combine=combine).collect()}
    want = set()
    for k in {r[1] for r in rows}:
        want |= {(k, r[0]) for r in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))[:4]}
    assert got == want


def test_groups_of_two_keys_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 7), (None, "a", 1), (1, "a", 2)], "a int, b string, v int")

    def total(key, batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        n = sum(pc.sum(b.column("v")).as_py() for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64())], ["a", "n"])

    got = per_group(df, ["a", "b"], total, "a int, n long").collect()
    assert sorted((r.a or 0, r.n) for r in got) == [(0, 1), (1, 2), (1, 12)]
    with pytest.raises(ValueError, match="more than 1 rows"):
        per_group(df, ["a", "b"], total, "a int, n long", max_rows=1)
    assert per_group(df.limit(0), ["a"], least(2, ["v"]), combine=True).count() == 0


def test_step_report(spark):
    report = StepReport()
    rows = report.watch("read", spark.range(100))
    rows = report.watch("even", rows.where("id % 2 = 0").withColumn("x", F.lit(1)))
    assert rows.count() == 50
    assert [tuple(r) for r in report.table(spark).collect()] == [("read", 100, 1, 0), ("even", 50, 2, 50)]


def test_elements(spark):
    html = "<p>a <b>x</b></p><!-- <p>no</p> --><div><p>b<p>c</p> tail</p></div><P>&amp;d"
    assert element_texts(html, "p") == ["a x", "b c tail", "&d"]
    assert element_texts("", "p") == [] == element_texts("<i>no", "p")
    extract.register_table_functions(spark)
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p></p>")], "id long, html string")
    got = spark.sql("SELECT id, e.* FROM {p}, LATERAL page_elements(html, 'p') e", p=pages).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a x"), (1, 1, "b c tail"), (1, 2, "&d"), (3, 0, "")]


def test_end_of_a_search(spark, tmp_path):
    model = LinearModel([0, 1], np.array([[-1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]), 10.0, 0)
    test = spark.createDataFrame([([1.0, 0.0], 1), ([-1.0, 5.0], 0), ([2.0, 0.0], 0), ([3.0, 1.0], 1)], "f array<double>, y int")
    path = str(tmp_path / "run")
    row = jobs.finish_search(spark, model, test, "f", "y", path, (6, 2, 9)).first()
    assert (row.log10_c, row.test_accuracy, row.budget.evaluations) == (1.0, 0.75, 9)
    assert np.allclose(load_model(spark, f"{path}/model").weights, model.weights)


def test_topics_of_a_model_without_calibration(spark):
    rng = np.random.default_rng(1)
    model = LinearModel([0, 1, 2], rng.normal(size=(3, 65)), 1.0, 0)
    df = spark.createDataFrame([(1, "red fox", "runs"), (2, None, None)], "id int, title string, content string")
    for r in jobs.rank_topics(df, model, ["a", "b", "c"], "title", "content").collect():
        scores = [t["score"] for t in r.topics]
        assert abs(sum(scores) - 1) < 1e-6 and scores == sorted(scores, reverse=True)
        assert r.topic == r.topics[0]["label"] and {t["label"] for t in r.topics} == {"a", "b", "c"}
