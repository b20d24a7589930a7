"""Evaluation tables from (truth, prediction) or (truth, scores) rows.

Everything starts from a small grouped count, so the data is read once and combined on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicweave.functions.fixed_values import UNKNOWN_LABEL_PREFIX
from topicweave.operators.ranking import running_sums, with_quantile_bucket
from topicweave.session import staged


def pair_counts(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (truth, prediction)."""
    cols = [*by, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")]
    return df.select(*cols).groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return pairs.groupBy(*by).agg((right / F.sum("n")).alias("accuracy"))


def per_class(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label found in truth or prediction; undefined values are zero."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("in_true"), F.lit(0).cast("bigint").alias("in_pred")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("in_true"), F.col("n").alias("in_pred")),
    )
    sums = pairs.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("in_true").alias("support"), F.sum("in_pred").alias("predicted")
    )
    zero = F.lit(0.0)
    return sums.select(
        *by,
        "label",
        F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")), zero).alias("f1"),
        "support",
    )


def macro_f1(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_class(pairs, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def named(df: DataFrame, names: Mapping, *cols: str) -> DataFrame:
    """Label names in place of label values; a label without a name gets the fallback text, null stays null."""
    pairs = [(F.lit(k), F.lit(v)) for k, v in names.items()]

    def name(c: str):
        fallback = F.concat(F.lit(UNKNOWN_LABEL_PREFIX), F.col(c).cast("string"))
        return reduce(lambda out, kv: F.when(F.col(c) == kv[0], kv[1]).otherwise(out), pairs, fallback)

    return df.withColumns({c: name(c) for c in cols})


def class_report(pairs: DataFrame, names: Mapping | None = None) -> DataFrame:
    """Per-class rows followed by accuracy, macro average and support-weighted average. ``names``: names of labels.

    Works on the per-class table (one row per label), which comes from one aggregation of the pair counts.
    """
    table = per_class(pairs)
    shown = table if names is None else named(table, names, "label")
    rows = shown.select(F.col("label").cast("string").alias("row_name"), "precision", "recall", "f1", "support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    macro = table.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    micro = pairs.agg((right / F.sum("n")).alias("accuracy"), F.sum("n").alias("support"))
    return (
        rows.unionByName(
            micro.select(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"), "support"))
        .unionByName(macro.withColumn("row_name", F.lit("macro avg")))
        .unionByName(table.agg(*[weighted(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
                     .withColumn("row_name", F.lit("weighted avg")))
    )


def confusion_matrix(pairs: DataFrame, normalize: bool = False) -> DataFrame:
    """Complete square table over the labels found in truth or prediction; with ``normalize`` each row of a true label
    sums to one, and a label without true rows stays zero.

    A missing truth or prediction is a label of its own, null, as in ``per_class``; accuracy counts such rows as wrong.
    Completed by listing all labels next to each label, which has k x k rows for k labels.
    """
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y_true").alias("v")), F.struct(F.col("y_pred").alias("v")))).alias("label"))
    listed = sides.agg(F.sort_array(F.collect_set("label")).alias("labels"))
    grid = listed.select(F.explode("labels").alias("_t"), "labels").select("_t", F.explode("labels").alias("_p"))
    same = grid["_t.v"].eqNullSafe(pairs["y_true"]) & grid["_p.v"].eqNullSafe(pairs["y_pred"])
    full = grid.join(pairs, same, "left").select(
        F.col("_t.v").alias("y_true"), F.col("_p.v").alias("y_pred"), F.coalesce("n", F.lit(0)).alias("n")
    )
    if not normalize:
        return full
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return full.select("y_true", "y_pred", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)).alias("ratio"))


def score_table(df: DataFrame, truth: str, scores: str, classes: Sequence, max_classes: int | None = None) -> DataFrame:
    """Positives and negatives per (class, distinct score), one-vs-rest, plus ``micro`` rows over all classes.

    ``max_classes`` limits the listed classes; the micro rows always cover every class.
    """
    names = F.array(*[F.lit(c).cast("string") for c in classes])
    each = df.select(F.col(truth).cast("string").alias("_y"), F.posexplode(F.col(scores).cast("array<double>")).alias("_i", "score"))
    name = F.get(names, F.col("_i"))
    micro = F.lit("micro")
    shown = F.array(name, micro) if max_classes is None else F.when(F.col("_i") < max_classes, F.array(name, micro)).otherwise(F.array(micro))
    hit = (F.col("_y") == name).cast("bigint")
    rows = each.select(F.explode(shown).alias("class"), "score", hit.alias("_hit"))
    return rows.groupBy("class", "score").agg(F.sum("_hit").alias("pos"), F.sum(1 - F.col("_hit")).alias("neg"))


def roc_points(table: DataFrame) -> DataFrame:
    """False and true positive rates at every distinct score of a class, from the highest score down.

    Running counts go through score buckets: the points of one class, as many as it has scores, never meet in a task.
    The table is used several times (quantiles, totals, sums), so it is written out first.
    """
    table = staged(table, "scores")
    bucketed = with_quantile_bucket(table, "score", "_bucket")
    sums = {"tp": F.col("pos"), "fp": F.col("neg")}
    cum = running_sums(bucketed, ["class"], "_bucket", [F.desc("score")], sums, descending_bucket=True)
    # one row per class given by the caller, and one for micro
    totals = table.groupBy("class").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return cum.join(F.broadcast(totals), "class").select(
        "class",
        "score",
        F.try_divide(F.col("fp"), F.col("q")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("p")).alias("tpr"),
        "pos",
        "neg",
        "tp",
        "p",
        "q",
    )


def roc_auc(table: DataFrame) -> DataFrame:
    """Area under the curve of each class. A step from one score to the next adds its negatives times the mean of the
    true positives before and after it; products of counts outgrow a bigint, hence doubles."""
    area = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0)
    whole = F.max("p").cast("double") * F.max("q").cast("double")
    return roc_points(table).groupBy("class").agg(F.try_divide(F.sum(area), whole).alias("auc"))
