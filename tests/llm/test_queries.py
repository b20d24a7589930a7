"""Registered queries: same rows as their SQL, or one sensible row per input row; and the pipeline as a whole."""

import brute
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicweave.llm.ftrl import held_out
from topicweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    ("name", "label", "said", "least"), [("op3_toxicity", "toxic", "predicted", 0.7), ("op7_quality_bayes", "quality", "kept", 0.9)]
)
def test_held_out_accuracy(spark, name, label, said, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(held_out(F.col("doc_id")))
    rows = QUERIES[name](spark, sf).join(labels, "doc_id").selectExpr(f"cast({said} as int) AS p", f"{label} AS y").collect()
    right = sum(r.p == r.y for r in rows)
    rare = 1 if label == "toxic" else 0
    hits = sum(r.p == r.y == rare for r in rows)
    assert right > 0.96 * len(rows)
    assert hits > 0.95 * sum(r.p == rare for r in rows)  # clean documents are left alone
    assert hits > least * sum(r.y == rare for r in rows)


def test_pipeline(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == table.columns
        docs = spark.createDataFrame(after.toArrow(), table.schema)
    rows = corpus_pipeline.run(spark, SF).collect()

    # the plain version
    source = {r.doc_id: r for r in table.collect()}
    from topicweave.llm import quality_rules

    kept = {r.doc_id for r in quality_rules.judge(table, keep=["doc_id"]).where("kept").collect()}
    for d in kept:
        words, *_, repeats = brute.quality_counts(source[d].text)
        assert words >= 50 and 100 * repeats <= 50 * words
    order = sorted(kept)
    roots = brute.components([brute.fingerprint(source[d].text) for d in order])
    one = {order[r] for r in roots}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from topicweave.llm import decontaminate

    leaked = {r.doc_id for r in decontaminate.overlaps(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {r.doc_id for r in docs.collect()} == one - leaked
    for r in docs.collect():
        assert not brute.secrets(r.text) and r.n_chars == len(r.text)
        if not brute.secrets(source[r.doc_id].text):
            assert r == source[r.doc_id]
    assert {r.doc_id for r in rows} == one - leaked
