"""Composite jobs: from a corpus to cleaned text, features, models and reports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions import text as tx
from topicweave.functions.fixed_values import DEFAULT_SEED
from topicweave.functions.vectors import ranked, softmax
from topicweave.operators import features as ft
from topicweave.operators import metrics as mt
from topicweave.operators.calibrate import CalibratedModel, predict_proba
from topicweave.operators.curate import article_text, keep_first, require_columns
from topicweave.operators.extract import html_text
from topicweave.operators.lexicon import segment_words
from topicweave.operators.linear_svm import LinearModel, decision_scores, fit_linear, pack_blocks, predict
from topicweave.operators.profile import StepReport
from topicweave.operators.sampling import stratified_split
from topicweave.session import staged, staging
from topicweave.sources.models import load_model, run_summary, save_model, save_summary
from topicweave.sources.tables import read_features, write_features


def dedup_articles(
    df: DataFrame, split: str, pos: str, link: str = "link", title: str = "title", report: StepReport | None = None
) -> DataFrame:
    """First row of each link per split, then first row of each title among those.

    Both passes work on narrow rows of digests, written once; the articles themselves are read once more, to pick the
    survivors by split and position. A ``report`` gets the rows before, between and after the passes; the survivors'
    keys are then written too, so that its table is complete when this returns.
    """
    watch = report.watch if report else lambda step, frame: frame
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    keys = staged(watch("all", df).select(split, pos, digest(link).alias("_link"), digest(title).alias("_title")), "dedup-keys")
    first = staged(watch("first of link", keep_first(keys, "_link", pos, [split])), "dedup-links")
    kept = watch("first of title", keep_first(first, "_title", pos, [split])).select(F.col(split).alias("_s"), F.col(pos).alias("_p"))
    if report:
        kept = staged(kept, "dedup-titles")
    return df.join(kept, df[split].eqNullSafe(kept["_s"]) & (df[pos] == kept["_p"]), "left_semi")


def clean_before_composing(df: DataFrame, text: str, stop: list[str]) -> DataFrame:
    """Lower, clean, NFC, tone marks, stop words. Cleaning comes before composition, so the marks of decomposed text
    are lost; ``clean_articles`` avoids that. Each step is a projection of its own, evaluated once per row."""
    c = F.col(text)
    steps = (lambda: tx.clean(tx.lower(c)), lambda: tx.nfc(c), lambda: tx.normalize_tone(c), lambda: tx.drop_words(c, stop))
    for step in steps:
        df = df.withColumn(text, step())
    return df


def clean_html(df: DataFrame, html: str, stop: list[str], out: str = "text") -> DataFrame:
    """The chain above, starting from HTML."""
    return clean_before_composing(html_text(df, html, out).drop("error"), out, stop)


def clean_articles(
    df: DataFrame, text: str, row_id: str, lexicon: DataFrame | None = None, first_sentence_only: bool = False
) -> DataFrame:
    """Lower, NFC, tone marks, word segmentation (with a lexicon), clean. Null text stays null."""
    c = F.col(text)
    out = df.withColumn(text, tx.lower(c)).withColumn(text, tx.nfc(c)).withColumn(text, tx.normalize_tone(c))
    if lexicon is not None:
        out = segment_words(out, text, row_id, lexicon, first_sentence_only=first_sentence_only)
    return out.withColumn(text, tx.clean(c))


def prepare_features(
    df: DataFrame,
    path: str,
    row_id: str,
    title: str = "title",
    content: str = "content",
    label: str = "topic",
    test_size: float | None = 0.2,
    seed: int = DEFAULT_SEED,
    make_encoder=ft.HashedEncoder,
) -> DataFrame:
    """Assemble text, split by class (not with ``test_size`` None), encode, and store the feature table by split."""
    rows = article_text(df, title, content, label).select(row_id, "text", F.col(label).alias("label"))
    if test_size is not None:
        rows = stratified_split(rows, "label", row_id, test_size, seed)
    write_features(ft.embed(rows, "text", make_encoder).drop("text"), path)
    return read_features(df.sparkSession, path)


def embed_articles(df: DataFrame, cols: list[str], row_id: str, make_encoder=ft.HashedEncoder) -> DataFrame:
    """Features of several text columns joined by single spaces, missing ones counting as empty."""
    require_columns(df, cols)
    joined = df.select(row_id, tx.assemble([F.col(c) for c in cols], " ").alias("text"))
    return ft.embed(joined, "text", make_encoder).drop("text")


@dataclass
class Report:
    pairs: DataFrame
    accuracy: DataFrame
    macro_f1: DataFrame
    classes: DataFrame
    confusion: DataFrame


def report(pairs: DataFrame, normalize: bool = True) -> Report:
    return Report(
        pairs, mt.accuracy(pairs), mt.macro_f1(pairs), mt.class_report(pairs), mt.confusion_matrix(pairs, normalize)
    )


def train_linear(df: DataFrame, features: str, label: str, row_id: str, c: float = 1.0) -> LinearModel:
    with staging(df.sparkSession):
        blocks = pack_blocks(df, features, label, row_id)
        try:
            return fit_linear(blocks, [c])[0, 0]
        finally:
            blocks.close()


def score_dataset(df: DataFrame, model: LinearModel, features: str, label: str) -> Report:
    """Report of a stored model on another labelled table."""
    return report(mt.pair_counts(predict(df, model, features), label, "prediction"))


def finish_search(
    spark: SparkSession, model: LinearModel, test: DataFrame, features: str, label: str, path: str,
    budget: tuple[int, int, int],
) -> DataFrame:
    """End of a search: the refitted model is stored, read back and scored on the test rows, and the run's summary (C, scores,
    budget of population, generations and distinct evaluations) is stored beside it and returned."""
    save_model(model, spark, f"{path}/model")
    done = score_dataset(test, load_model(spark, f"{path}/model"), features, label)
    accuracy, f1 = done.accuracy.first()["accuracy"], done.macro_f1.first()["macro_f1"]
    save_summary(run_summary(spark, math.log10(model.c), accuracy, f1, *budget), f"{path}/summary")
    return spark.read.json(f"{path}/summary")


def rank_topics(
    df: DataFrame, model: CalibratedModel | LinearModel, names: list[str], title: str, content: str, make_encoder=ft.HashedEncoder
) -> DataFrame:
    """From raw title and content: predicted topic name and all (name, probability) pairs, best first. A model that is not
    calibrated ranks by the softmax of its scores."""
    text = F.trim(tx.assemble([F.col(title), F.col(content)], " "))
    rows = ft.embed(df.withColumn("_text", text), "_text", make_encoder, "_vec")
    if isinstance(model, LinearModel):
        probs = decision_scores(rows, model, "_vec", "_probs").withColumn("_probs", softmax(F.col("_probs")))
    else:
        probs = predict_proba(rows, model, "_vec", "_probs")
    labels = F.array(*[F.lit(names[k]) if k < len(names) else F.lit(str(k)) for k in model.classes])
    out = probs.withColumn("topics", ranked(F.col("_probs"), labels))
    return out.withColumn("topic", F.col("topics")[0]["label"]).drop("_text", "_vec", "_probs")
