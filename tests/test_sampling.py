import collections

import pytest
from pyspark.sql import functions as F

from topicweave.operators import sampling
from topicweave.operators.ranking import position_bucket, rank_in_group, with_quantile_bucket


def table(spark, sizes, parts=3):
    data, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            data.append((i, label))
            i += 1
    return spark.createDataFrame(data, "id bigint, label int").repartition(parts, "id")


def count(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_split_quotas(spark):
    got = sampling.stratified_split(table(spark, {0: 7, 1: 5, 2: 3}), "label", "id")
    assert count(got.where("split = 'test'"), "label") == {(0,): 1, (1,): 1, (2,): 1}


def test_split_errors(spark):
    with pytest.raises(ValueError):
        sampling.stratified_split(table(spark, {0: 7, 1: 1}), "label", "id")
    with pytest.raises(ValueError):
        sampling.stratified_split(table(spark, {i: 2 for i in range(5)}), "label", "id", test_size=0.1)


@pytest.mark.parametrize("make", [sampling.stratified_folds, sampling.stratified_blocks])
def test_fold_sizes(spark, make):
    got = make(table(spark, {0: 7, 1: 6}), "label", "id")
    assert sorted(count(got, "fold").values()) == [2, 2, 3, 3, 3]
    for label in (0, 1):
        per = count(got.where(F.col("label") == label), "fold").values()
        assert max(per) - min(per) <= 1 and len(per) == 5


def test_folds_of_a_class_smaller_than_the_number_of_folds(spark):
    got = sampling.stratified_folds(table(spark, {0: 12, 1: 3}), "label", "id")
    assert sorted(count(got, "fold").values()) == [3, 3, 3, 3, 3]
    with pytest.raises(ValueError):
        sampling.stratified_folds(table(spark, {0: 3, 1: 3}), "label", "id")


def test_blocks_are_contiguous_inside_a_class(spark):
    got = sampling.stratified_blocks(table(spark, {0: 20, 1: 11}), "label", "id").orderBy("id").collect()
    for label in (0, 1):
        folds = [r["fold"] for r in got if r["label"] == label]
        assert folds == sorted(folds)


@pytest.mark.parametrize("n,parts,sizes", [(10, 4, [3, 3, 3, 1]), (5, 4, [2, 2, 1]), (4, 1, [4])])
def test_contiguous_parts(spark, n, parts, sizes):
    df = spark.range(100, 100 + 3 * n, 3).withColumnRenamed("id", "pos")
    got = sampling.split_contiguous(df, parts, "pos")
    assert [r["n"] for r in sampling.part_manifest(got, "part", "pos").orderBy("part").collect()] == sizes


def test_result_does_not_depend_on_partitions(spark):
    def run(parts):
        df = table(spark, {0: 40, 1: 25, 2: 9}, parts)
        return [
            sorted(map(tuple, f(df).collect()))
            for f in (
                lambda d: sampling.undersample(d, "label", 10, "id"),
                lambda d: sampling.balance(d, "label", "id"),
                lambda d: sampling.stratified_split(d, "label", "id"),
                lambda d: sampling.shuffle_rows(d, "id"),
                lambda d: sampling.sample_rows(d, 17, "id"),
            )
        ]

    assert run(1) == run(3) == run(8)


def test_undersample_sizes_and_seed(spark):
    df = table(spark, {0: 40, 1: 25, 2: 4})
    a = sampling.undersample(df, "label", 10, "id")
    assert count(a, "label") == {(0,): 10, (1,): 10, (2,): 4}
    b = sampling.undersample(df, "label", 10, "id", seed=7)
    assert set(map(tuple, a.collect())) != set(map(tuple, b.collect()))
    assert sampling.undersample(df, "label", 0, "id").count() == 0
    assert sampling.sample_rows(df, 1000, "id").count() == 69


def test_shuffle_is_a_permutation(spark):
    got = sorted(r["row_pos"] for r in sampling.shuffle_rows(table(spark, {0: 57}), "id").collect())
    assert got == list(range(57))


def test_rank_through_coarse_buckets(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 200).alias("v"))
    got = rank_in_group(df.withColumn("b", position_bucket(df, "v", 4)), ["g"], "b", [F.col("v")], "rk").collect()
    for g in range(3):
        rows = sorted((r["v"], r["rk"]) for r in got if r["g"] == g)
        assert [rk for _, rk in rows] == list(range(1, len(rows) + 1))


def test_quantile_buckets_grow_with_the_value(spark):
    df = spark.range(300).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    rows = with_quantile_bucket(df, "v", "b", 8).orderBy("v").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets) and len(set(buckets)) == 8


def test_rows_without_a_label_are_refused_by_splits_and_folds(frame):
    df = frame([(i, None if i % 5 == 0 else i % 3) for i in range(60)], "i int, label int")
    for make in (sampling.stratified_split, sampling.stratified_folds, sampling.stratified_blocks):
        with pytest.raises(ValueError, match="without a label"):
            make(df, "label", "i")
