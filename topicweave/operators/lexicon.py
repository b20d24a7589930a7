"""Stop words by table, and word segmentation from corpus statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.text import first_sentence, words
from topicweave.operators.bounded import SALTS, counted_join, small_or_none, unused
from topicweave.operators.grams import chunks, cut, frequent_grams, glued, listed_and_rest, runs_among, shared_lexicon
from topicweave.session import staged

MAX_LEXICON = 2_000_000
MAX_WORDS = 500_000


def remove_stopwords(df: DataFrame, text: str, stop: DataFrame, row_id: str, out: str | None = None) -> DataFrame:
    """Drop the words listed in ``stop`` (one column ``word``), exact case, keeping repeats and order of the rest.

    A list that fits a broadcast is handed to ``StopWordsRemover``; a longer one is anti-joined to the exploded words
    of each distinct text, found again by its digest, so row ids may repeat or be missing on both paths.
    """
    out = out or text
    listed = small_or_none(stop.select("word").where("word is not null"))
    if listed is not None:
        remover = StopWordsRemover(
            inputCol="_words", outputCol="_kept", stopWords=[r["word"] for r in listed.toLocalIterator()], caseSensitive=True
        )
        kept = remover.transform(df.withColumn("_words", F.coalesce(words(F.col(text)), F.array())))
        joined = F.when(F.col(text).isNotNull(), F.array_join("_kept", " "))
        return kept.withColumn(out, joined).drop("_words", "_kept")
    digest = F.sha2(F.col(text).cast("binary"), 256)
    texts = df.where(F.col(text).isNotNull()).select(digest.alias("_digest"), text).dropDuplicates(["_digest"])
    tokens = texts.select("_digest", F.posexplode(words(F.col(text))).alias("_at", "word"))
    # both join sides are salted by position: a frequent word spreads over many tasks
    salted = tokens.withColumn("_salt", F.pmod(F.xxhash64("_digest", "_at"), F.lit(SALTS)))
    listed = stop.select("word").where("word is not null").distinct()
    listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    rest = salted.join(listed, ["word", "_salt"], "left_anti")
    again = rest.groupBy("_digest").agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_kept"))
    joined = F.when(F.col(text).isNotNull(), F.coalesce(F.array_join(F.col("_kept")["word"], " "), F.lit("")))
    return df.withColumn("_digest", digest).join(again, "_digest", "left").withColumn(out, joined).drop("_kept", "_digest")


def collocations(df: DataFrame, text: str, min_count: int) -> DataFrame:
    """Neighbouring word pairs seen at least ``min_count`` times, with their normalised pointwise mutual information.

    The single-word counts are looked up by word, once for each side; a frequent word is the left side of many
    distinct pairs, so hot words are broadcast and only the others are shuffled. The table of pairs is written out: a
    lexicon is used many times.
    """
    words_, pairs, n_pairs = frequent_grams(df, text, 2, min_count, clauses=False)
    n_words = words_.agg(F.sum("n")).first()[0]
    parts = F.split("gram", " ")
    kept = pairs.select(parts[0].alias("w1"), parts[1].alias("w2"), F.col("n").alias("n_pair"))
    singles = words_.where(F.col("n") >= min_count)  # the words of a frequent pair are frequent themselves
    for side in ("1", "2"):
        counts = singles.select(F.col("gram").alias(f"w{side}"), F.col("n").alias(f"n{side}"))
        pair = F.concat_ws(" ", "w1", "w2")
        kept = counted_join(kept, counts, [f"w{side}"], "inner", pair, n_col=f"n{side}", max_rows=MAX_WORDS)
    p12 = F.col("n_pair") / F.lit(n_pairs or 1)
    p1, p2 = F.col("n1") / F.lit(n_words or 1), F.col("n2") / F.lit(n_words or 1)
    npmi = F.when(p12 >= 1, F.lit(1.0)).otherwise(F.ln(p12 / (p1 * p2)) / -F.ln(p12))
    return staged(kept.select("w1", "w2", "n_pair", "n1", "n2", npmi.alias("npmi")), "lexicon")


def segment_words(
    df: DataFrame, text: str, row_id: str, lexicon: DataFrame, out: str | None = None, first_sentence_only: bool = False
) -> DataFrame:
    """Join neighbouring words that form a lexicon entry (columns ``w1``, ``w2``, ``n_pair``) with an underscore.

    A text is walked from left to right: a known pair is joined unless its first word has just been joined to the one
    before. A lexicon of at most ``MAX_LEXICON`` pairs is broadcast and many texts are looked up in it at once, without a
    shuffle. Of a larger one the most frequent pairs travel that way. The pairs of the texts are joined with the others: a
    bitmap sorts out nearly all unknown pairs before anything is shuffled, known pairs that are frequent in these texts are
    salted, and only the positions of the hits travel back. ``row_id`` must be unique for that.
    ``first_sentence_only`` keeps just the first sentence of every text.
    """
    out = out or text
    source = first_sentence(F.col(text)) if first_sentence_only else F.col(text)
    pair = F.concat("w1", F.lit(" "), "w2").alias("gram")
    known = lexicon.where("w1 IS NOT NULL AND w2 IS NOT NULL").select(pair, F.col("n_pair").cast("bigint").alias("weight"))
    known = staged(known.groupBy("gram").agg(F.coalesce(F.max("weight"), F.lit(0)).alias("weight")), "known-pairs")
    listed, rare = listed_and_rest(known, MAX_LEXICON)
    shared = shared_lexicon(df.sparkSession, listed)
    if rare is None:
        return df.withColumn(out, _glue_known(shared)[0](source))
    (read,) = unused(df.columns, "_source")
    texts = df.withColumn(read, source)
    pairs = runs_among(texts, read, row_id, rare, range(2, 3), clauses=False)
    counts = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    hits = counted_join(pairs, counts.join(rare, "gram", "left_semi"), ["gram"], "inner", F.col(row_id))
    found = hits.groupBy(row_id).agg(F.collect_list("at").alias("_hits"))
    return texts.join(found, row_id, "left").withColumn(out, _glue_known(shared)[1](F.col(read), F.col("_hits"))).drop(read, "_hits")


def _glue_known(shared):
    """Functions of texts, and of texts and the places of known pairs found elsewhere, that join known pairs from left to
    right: of pairs that overlap in a row, every other one."""

    def joined(texts: pa.Array, found: pa.Array | None) -> pa.Array:
        parts, lo = [], 0
        for some in chunks(texts):
            c = cut(some, clauses=False)
            known = np.zeros(len(c.first) + 1, bool)
            if shared.value is not None:
                for size, at, _ in shared.value.spans(c):
                    if size == 2:
                        known[at] = True
            if found is not None:
                theirs = found.slice(lo, len(some))
                begin = c.ends - np.diff(c.ends, prepend=0)
                known[theirs.flatten().to_numpy() + begin[pc.list_parent_indices(theirs).to_numpy()]] = True
            at = np.flatnonzero(known)
            new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            place = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            glue = np.zeros(len(c.first), bool)
            glue[at[place % 2 == 0] + 1] = True
            parts.append(glued(c, glue))
            lo += len(some)
        whole = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), whole)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return joined(texts, None)

    @F.arrow_udf("string")
    def run_with_hits(texts: pa.Array, found: pa.Array) -> pa.Array:
        return joined(texts, found)

    return run, run_with_hits
