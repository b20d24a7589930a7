"""Quality classifier with hierarchical empirical Bayes (operator 7).

Evidence of a document: a naive Bayes log-likelihood ratio over bucketed properties of its text (symbols, repeated lines
and words, word length, capitals, exclamation marks), counted over all labelled training rows. Prior of a document: the
quality of its path (a language within a source), shrunk toward that of its host (the source), which is shrunk toward the
global prior. Posterior: both combined.

The strength of each shrinkage is not set but estimated from the corpus by the method of moments: the spread of group
means beyond what documents within a group explain. Sparse groups so keep the prior of their parent. A document does not
count in its own prior. Group sums are plain grouped aggregations, combined on the map side, and are joined back either
by broadcast, after a check of their size, or with the keys of large groups salted.

Labels are taken only from rows whose crc32 of the doc_id as text leaves a remainder other than 1 by 3. Null and empty
texts have evidence like any other text. Null host or path is a group of its own. Rows with a null id are scored and do
not train. Without labels the global prior is one half and evidence is zero. Repeated rows count repeatedly; an empty
table gives an empty result. Further columns stay if listed in ``keep``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import UPPER, query, table
from topicweave.llm.ftrl import held_out
from topicweave.llm.quality_rules import ratios, sketch_bucket, with_counts
from topicweave.operators.bounded import counted_join
from topicweave.session import staged

SMOOTH = 1.0
#: one property has at most so much weight, so that a rare bucket does not decide alone
MAX_EVIDENCE = 4.0
MAX_BUCKET = 400
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1e5
KEEP_FROM = 0.5


def _properties() -> dict[str, Column]:
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return ratios() | {
        "capitals": F.floor(F.col("n_upper") * 1000 / chars).cast("bigint"),
        "marks": F.floor(F.col("n_marks") * 1000 / words).cast("bigint"),
        "size": F.col("n_words"),
    }


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def evidence_table(rows: DataFrame, labels: DataFrame, label: str) -> tuple[float, dict[str, list[float]]]:
    """Global prior, and per property the log-likelihood ratio of each bucket. A few thousand numbers at most."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    long = rows.join(own, "doc_id").select("y", F.posexplode("buckets").alias("property", "bucket"))
    counts = long.groupBy("property", "bucket").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).collect()
    names = [*_properties()]
    table_of = {n: [0.0] * (MAX_BUCKET + 1) for n in names}
    good = sum(r["good"] for r in counts if r["property"] == 0)
    bad = sum(r["bad"] for r in counts if r["property"] == 0)
    for i, name in enumerate(names):
        seen = [r for r in counts if r["property"] == i]
        for r in seen:
            ratio = (r["good"] + SMOOTH) / (good + SMOOTH * len(seen)) * (bad + SMOOTH * len(seen)) / (r["bad"] + SMOOTH)
            table_of[name][r["bucket"]] = max(-MAX_EVIDENCE, min(MAX_EVIDENCE, math.log(ratio)))
    return (good + 1) / (good + bad + 2), table_of


def _strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-count of the parent's prior, by moments: groups that differ no more than chance would get the largest."""
    usable = groups.where("n > 1")
    var = F.greatest((F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    r = usable.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(mean), 2)).alias("between"),
        F.sum(var).alias("noise"), F.sum(F.col("n") * var).alias("within"), F.count(F.lit(1)).alias("k"),
    ).first()
    if not r["n"] or r["k"] < 2:
        return MAX_STRENGTH
    spread = (r["between"] - r["noise"]) / r["n"]
    within = r["within"] / r["n"]
    return min(MAX_STRENGTH, max(MIN_STRENGTH, within / spread)) if spread > 0 else MAX_STRENGTH


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", host: str = "source", path: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``evidence``, ``prior`` and ``posterior`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    marks = F.length(text) - F.length(F.translate(text, "!", ""))
    keep = tuple(dict.fromkeys([*keep, "doc_id"]))
    named = docs.select(*keep, F.col(host).alias("_host"), F.col(path).alias("_path"), text.alias("text"), upper.alias("n_upper"), marks.alias("n_marks"))
    counted = with_counts(named, "text", [*keep, "_host", "_path", "n_upper", "n_marks"])
    buckets = F.array(*[F.least(sketch_bucket(c), F.lit(MAX_BUCKET)).cast("int") for c in _properties().values()])
    rows = staged(counted.select(*keep, "_host", "_path", buckets.alias("buckets")), "quality-buckets")
    prior, table_of = evidence_table(rows, labels, label)
    ratio = F.from_json(F.lit(json.dumps([*table_of.values()])), "array<array<double>>")  # a constant of a few kilobytes
    evidence = F.aggregate(
        F.sequence(F.lit(0), F.size("buckets") - 1), F.lit(0.0), lambda acc, i: acc + F.get(F.get(F.col("_ratio"), i), F.get(F.col("buckets"), i))
    )
    scored = rows.withColumn("_ratio", ratio).withColumn("evidence", evidence).drop("_ratio", "buckets")
    scored = staged(scored.withColumn("own", 1 / (1 + F.exp(-(F.col("evidence") + math.log(prior / (1 - prior)))))), "quality-evidence")

    sums = [F.count(F.lit(1)).alias("n"), F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("s2")]
    paths = staged(scored.groupBy("_host", "_path").agg(*sums), "quality-paths")
    hosts = staged(paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")]), "quality-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else prior
    by_host, by_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select(F.col("_host").alias("_h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    both = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h")), "left").select("_host", "_path", "n", "s", "hn", "hs")
    joined = counted_join(scored, both, ["_host", "_path"], "left", F.xxhash64("doc_id", "evidence"))
    own = F.col("own")
    at_host = (F.col("hs") - own + by_host * mean) / (F.col("hn") - 1 + by_host)
    at_path = (F.col("s") - own + by_path * at_host) / (F.col("n") - 1 + by_path)
    joined = joined.withColumn("prior", at_path)
    return joined.select(*keep, "evidence", "prior", (1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("prior")))))).alias("posterior"))


@query("op7_quality_bayes")
def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "prior", "posterior", (F.col("posterior") >= KEEP_FROM).alias("kept"))
