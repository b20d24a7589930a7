"""Sentence boundaries from the corpus itself: which words are abbreviations, and which ones start sentences.

A word that nearly always stands before a period is an abbreviation. How much so is told by a log-likelihood ratio between
"the period belongs to the word" and "periods stand as often behind this word as behind any other"; short words with
periods inside weigh more, words that also occur without a period less. A word that follows sure ends of sentences more
often than chance has it is a starter. An abbreviation ends a sentence only before a starter that begins with a capital.
(Kiss and Strunk, "Unsupervised multilingual sentence boundary detection", 2006.)

All counts come from two grouped aggregations; the list of flagged words is what travels to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions.text import words
from topicweave.operators.bounded import join_lookup
from topicweave.session import staged

#: published constants of the method
PERIOD_OF_ABBREVIATION = 0.99
LEAST_ABBREVIATION = 0.3
LEAST_STARTER = 30.0
WORD = r"^[\p{L}](?:[\p{L}.]*[\p{L}])?\.?$"
ENDS = r"[.!?…]$"


def _type(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"\.$", ""))


def _tokens(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Every word with the one behind it, by text."""
    listed = df.select(*(keep or []), words(F.col(text)).alias("_t"))
    ahead = F.concat(F.slice("_t", F.lit(2), F.size("_t")), F.array(F.lit(None).cast("string")))
    pairs = F.when(F.size("_t") > 0, F.arrays_zip(F.col("_t").alias("token"), ahead.alias("next")))
    return listed.select(*(keep or []), F.posexplode(pairs).alias("at", "_p")).select(*(keep or []), "at", "_p.token", "_p.next")


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    return k * F.ln(p) + (n - k) * F.ln(1 - p)


def learn_marks(df: DataFrame, text: str) -> DataFrame:
    """Per word type: ``n_dot`` and ``n_plain`` occurrences with and without a period, ``score`` and ``is_abbreviation``;
    ``n_start`` occurrences behind a sure end, ``start_score`` and ``is_starter``."""
    tokens = _tokens(df, text)
    words_ = tokens.where(F.col("token").rlike(WORD))
    counts = words_.groupBy(_type(F.col("token")).alias("type")).agg(
        F.count_if(F.endswith("token", F.lit("."))).alias("n_dot"), F.count_if(~F.endswith("token", F.lit("."))).alias("n_plain")
    )
    counts = staged(counts, "word-types")
    n_all, n_dots = counts.agg(F.coalesce(F.sum(F.col("n_dot") + F.col("n_plain")), F.lit(0)), F.coalesce(F.sum("n_dot"), F.lit(0))).first()
    n = F.col("n_dot") + F.col("n_plain")
    share = F.lit(min(max(n_dots / max(n_all, 1), 1e-9), 1 - 1e-9))
    ratio = -2 * (_log_likelihood(F.col("n_dot"), n, share) - _log_likelihood(F.col("n_dot"), n, F.lit(PERIOD_OF_ABBREVIATION)))
    inside = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inside).cast("double")
    score = F.when(F.col("n_dot") > 0, ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -F.col("n_plain").cast("double"))).otherwise(0.0)
    marked = counts.withColumn("score", F.round(score, 6)).withColumn("is_abbreviation", F.col("score") >= LEAST_ABBREVIATION)
    marked = staged(marked, "abbreviations")
    # behind marks that are no periods, and behind periods of words that are no abbreviations
    sure = tokens.where(F.col("token").rlike(ENDS) & F.col("next").isNotNull()).withColumn("type", _type(F.col("token")))
    sure = join_lookup(sure, marked.where("is_abbreviation").select("type", "is_abbreviation"), ["type"], "left", spread=F.col("next"))
    starts = sure.where("is_abbreviation IS NULL AND next RLIKE '^\\\\p{L}'").groupBy(_type(F.col("next")).alias("type")).agg(F.count(F.lit(1)).alias("n_start"))
    starts = staged(starts, "starters")
    n_ends = starts.agg(F.coalesce(F.sum("n_start"), F.lit(0))).first()[0]
    both = marked.join(starts, "type", "left").na.fill(0, ["n_start"])
    rest = max(n_all - n_ends, 1)
    inner = F.greatest(n - F.col("n_start"), F.lit(0))
    inside_share = lambda k, total: F.least(F.greatest(k / F.lit(float(max(total, 1))), F.lit(1e-9)), F.lit(1 - 1e-9))
    p, p1, p2 = inside_share(n, n_all), inside_share(F.col("n_start"), n_ends), inside_share(inner, rest)
    start = 2 * (
        _log_likelihood(F.col("n_start"), F.lit(n_ends), p1) + _log_likelihood(inner, F.lit(rest), p2)
        - _log_likelihood(F.col("n_start"), F.lit(n_ends), p) - _log_likelihood(inner, F.lit(rest), p)
    )
    both = both.withColumn("start_score", F.round(F.when(F.col("n_start") > 0, start).otherwise(0.0), 4))
    return both.withColumn("is_starter", (F.col("start_score") >= LEAST_STARTER) & (p1 > p))


def split_sentences(df: DataFrame, text: str, row_id: str, marks: DataFrame, out: str = "sentences") -> DataFrame:
    """Sentences of every text as an array; null text stays null. ``row_id`` must be unique."""
    ends = _tokens(df, text, [row_id]).where(F.col("token").rlike(ENDS) & F.col("next").isNotNull())
    ends = ends.withColumns({"type": _type(F.col("token")), "next_type": _type(F.col("next"))})
    short = marks.where("is_abbreviation").select("type", "is_abbreviation")
    starter = marks.where("is_starter").select(F.col("type").alias("next_type"), "is_starter")
    known = join_lookup(ends, short, ["type"], "left", spread=F.struct(row_id, "at"))
    known = join_lookup(known, starter, ["next_type"], "left", spread=F.struct(row_id, "at"))
    capital = F.col("next").rlike(r"^\p{Lu}")
    breaks = known.where(F.col("is_abbreviation").isNull() | ~F.endswith("token", F.lit(".")) | (F.col("is_starter").isNotNull() & capital))
    cuts = breaks.groupBy(row_id).agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("_cuts"))  # bounded by the text
    joined = df.join(cuts, row_id, "left").withColumn("_t", words(F.col(text)))
    edges = F.concat(F.array(F.lit(0)), F.coalesce("_cuts", F.array().cast("array<int>")), F.array(F.size("_t")))
    lists = F.transform(F.sequence(F.lit(1), F.size("_e") - 1), lambda i: F.array_join(F.slice("_t", F.get("_e", i - 1) + 1, F.get("_e", i) - F.get("_e", i - 1)), " "))
    made = joined.withColumn("_e", edges)
    return made.withColumn(out, F.when(F.col("_t").isNotNull(), F.filter(lists, lambda s: s != ""))).drop("_cuts", "_t", "_e")
