import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.functions import vectors as vx
from topicweave.operators import features, metrics, profile


def test_three_class_report(frame):
    pairs = metrics.pair_counts(frame([(0, 0), (0, 1), (1, 1), (1, 2)], "y int, p int"), "y", "p")
    f1 = {r["label"]: r["f1"] for r in metrics.per_class(pairs).collect()}
    assert f1 == pytest.approx({0: 2 / 3, 1: 1 / 2, 2: 0})
    assert metrics.macro_f1(pairs).first()[0] == pytest.approx(7 / 18)
    assert metrics.accuracy(pairs).first()[0] == 0.5
    cells = {(r["y_true"], r["y_pred"]): r["ratio"] for r in metrics.confusion_matrix(pairs, True).collect()}
    assert len(cells) == 9 and cells[0, 1] == 0.5 and [cells[2, i] for i in range(3)] == [0, 0, 0]
    assert sum(r["n"] for r in metrics.confusion_matrix(pairs).collect()) == 4
    rows = {r["row_name"]: r for r in metrics.class_report(pairs).collect()}
    assert rows["weighted avg"]["recall"] == pytest.approx(0.5) and rows["accuracy"]["support"] == 4


def test_tied_scores_are_one_point(frame):
    df = frame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "y int, s double")
    table = metrics.score_table(df.select("y", vx.two_columns(F.col("s")).alias("s")), "y", "s", [0, 1])
    points = metrics.roc_points(table).where("class = '1'").orderBy(F.desc("score")).collect()
    assert [(r["fpr"], r["tpr"]) for r in points] == [(0, 0.5), (0.5, 1), (1, 1)]
    assert {r["class"]: r["auc"] for r in metrics.roc_auc(table).collect()}["1"] == 0.875


def test_auc_equals_rank_sum(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 3, 300), np.round(rng.normal(size=(300, 3)), 1)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, s)], "y int, s array<double>")
    got = {r["class"]: r["auc"] for r in metrics.roc_auc(metrics.score_table(df, "y", "s", [0, 1, 2], 2)).collect()}
    assert set(got) == {"0", "1", "micro"}
    for c in (0, 1):
        p, q = s[y == c, c], s[y != c, c]
        want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
        assert got[str(c)] == pytest.approx(want)


def test_confidence_gap_and_order(frame):
    df = frame([([0.3, 0.5, 0.2],), ([0.4, 0.4, 0.2],)], "p array<double>")
    labels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    got = df.select(
        vx.confidence("p"), vx.margin(F.col("p")), vx.argmax(F.col("p")), vx.ranked(F.col("p"), labels)["label"]
    ).collect()
    assert got[0][0] == 0.5 and got[0][1] == pytest.approx(0.2) and got[0][2] == 1 and got[0][3] == ["b", "a", "c"]
    assert got[1][2] == 0 and got[1][3] == ["a", "b", "c"]


def test_softmax_and_norm(frame):
    df = frame([([1000.0, 1000.0],), ([0.0, 0.0],)], "v array<double>")
    got = df.select(vx.softmax(F.col("v")), vx.l2_normalize(F.col("v"))).collect()
    assert got[0][0] == [0.5, 0.5] and got[1][1] == [0.0, 0.0]


def test_mean_pool(frame):
    data = [(1, [1.0, 0.0], 1), (1, [3.0, 0.0], 1), (1, [9.0, 9.0], 0), (2, [4.0, 4.0], 0)]
    got = features.mean_pool(frame(data, "d int, v array<float>, m int"), "d", "v", "m")
    assert {r["d"]: r["features"] for r in got.collect()} == {1: [2.0, 0.0], 2: [0.0, 0.0]}


def test_encoder_truncates_only_on_request(frame):
    whole, cut = features.HashedEncoder(16), features.HashedEncoder(16, max_tokens=2)
    assert np.array_equal(cut(["a b c d"]), whole(["a b"])) and not np.array_equal(whole(["a b c d"]), whole(["a b"]))
    assert whole(["", None]).tolist() == [[0.0] * 16] * 2
    df = frame([(i, f"w{i} x") for i in range(10)] + [(10, None)], "i int, t string")
    norms = features.embed(df, "t").select("i", F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert [round(r[1], 5) for r in sorted(norms)] == [1.0] * 10 + [0.0]


def test_label_codes_round_trip(frame):
    df = frame([("b",), ("a",), ("c",), ("a",)], "label string")
    coded, names = features.encode_labels(df, "label")
    assert names == ["a", "b", "c"] and sorted(r["label_code"] for r in coded.collect()) == [0, 0, 1, 2]
    back = features.decode_labels(coded.drop("label"), "label_code", names)
    assert sorted(r["label"] for r in back.collect()) == ["a", "a", "b", "c"]


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<float>")
    g = profile.kernel_gamma(df, "v").first()["gamma"]
    assert g == pytest.approx(1 / (5 * x.astype(float).var()), rel=1e-5)
    z = np.array([r["features"] for r in features.fourier_features(df, "v", 4096).orderBy("i").collect()])
    want = np.exp(-g * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_a_missing_side_counts_in_every_table(frame):
    data = [(0, 0), (0, None), (None, 1), (1, 1), (1, 0), (None, None)]
    pairs = metrics.pair_counts(frame(data, "y int, p int"), "y", "p")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(pairs).collect()}
    assert sum(cells.values()) == 6 and len(cells) == 9 and cells[None, None] == 1 and cells[0, None] == 1
    ratios = {(r["y_true"], r["y_pred"]): r["ratio"] for r in metrics.confusion_matrix(pairs, True).collect()}
    assert ratios[None, 1] == 0.5 and ratios[0, 0] == 0.5
    assert sum(r["support"] for r in metrics.per_class(pairs).collect()) == 6


def test_names_in_report_and_confusion(frame):
    pairs = metrics.pair_counts(frame([(0, 0), (0, 1), (7, 7)], "y int, p int"), "y", "p")
    names = {0: "zero", 1: "one"}
    assert {"zero", "one", "Lớp 7", "accuracy"} <= {r["row_name"] for r in metrics.class_report(pairs, names).collect()}
    shown = metrics.named(metrics.confusion_matrix(pairs), names, "y_true", "y_pred").collect()
    assert {(r["y_true"], r["y_pred"]) for r in shown if r["n"]} == {("zero", "zero"), ("zero", "one"), ("Lớp 7", "Lớp 7")}
