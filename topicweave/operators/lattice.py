"""Word segmentation by the best path through a lattice: phrases of any number of words, weighed by their frequency.

Phrases are runs of up to ``max_words`` neighbouring words inside a clause, seen at least ``min_count`` times. The weight of
a phrase is the logarithm of its share of all words, in whole millionths, so that sums of weights are exact and equal
everywhere. Of all ways to cut a clause into known phrases and single words the one with the largest sum wins; between
equal ones, that whose last phrase is longer, from the end backwards.

A lexicon that fits a broadcast travels as a trie over numbers of words, in which many texts are looked up at once. Of a
larger one the heaviest phrases, which are most of what a text holds, travel that way. The others are joined: a bitmap sorts
out most other runs of the texts, hot runs are salted, and only the spans that are found go back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions.text import words
from topicweave.operators.bounded import counted_join
from topicweave.operators.grams import Cut, chunks, cut, frequent_grams, glued, listed_and_rest, runs_among, shared_lexicon
from topicweave.session import staged

MAX_LEXICON = 3_000_000
NEVER = -(1 << 60)
CLAUSE_END = r"([.!?…,;:])\s"


def clauses(text: Column) -> Column:
    """Lines of a text, cut also behind each mark that is followed by white space; each as a list of words."""
    return F.transform(F.split(F.regexp_replace(text, CLAUSE_END, "$1\n"), "\n"), words)


def phrases(df: DataFrame, text: str, max_words: int = 4, min_count: int = 5) -> DataFrame:
    """``gram``, ``size`` in words, ``n`` and ``weight`` of every word and of every frequent phrase of the texts."""
    words, runs, _ = frequent_grams(df, text, max_words, min_count, clauses=True)
    total = words.agg(F.sum("n")).first()[0] or 1
    counts = words.select("gram", F.lit(1).alias("size"), "n").unionByName(runs)
    return counts.withColumn("weight", F.round(F.ln(F.col("n") / F.lit(total)) * 1e6).cast("bigint"))


def best_path(spans: list[dict[int, int]], unknown: int) -> list[int]:
    """Sizes of the phrases on the best path. ``spans[i]``: weight by size of the phrases that end before place i + 1."""
    best, back = [0], [0]
    for i, found in enumerate(spans):
        options = {1: unknown} | found
        size = max(options, key=lambda k: (best[i + 1 - k] + options[k], k))
        best.append(best[i + 1 - size] + options[size])
        back.append(size)
    out, at = [], len(spans)
    while at:
        out.append(back[at])
        at -= back[at]
    return out[::-1]


def segment_lattice(df: DataFrame, text: str, row_id: str, lexicon: DataFrame, out: str | None = None) -> DataFrame:
    """Phrases of ``lexicon`` (``gram``, ``size``, ``weight``) on the best path are joined by underscores; ``row_id`` must be
    unique if the lexicon is larger than ``MAX_LEXICON``. A word that is not listed weighs as little as the rarest.
    Null stays null."""
    out = out or text
    unknown = lexicon.agg(F.min("weight")).first()[0] or 0
    lexicon = staged(_that_matter(lexicon), "lexicon")
    listed, rare = listed_and_rest(lexicon, MAX_LEXICON)
    if rare is None:
        return df.withColumn(out, _by_lexicon(listed, unknown)(F.col(text)))
    rare, longest = rare.select("gram", "weight"), lexicon.agg(F.max("size")).first()[0]
    runs = runs_among(df, text, row_id, rare, range(1, longest + 1), clauses=True)
    counts = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(rare, "gram")
    hits = counted_join(runs, counts, ["gram"], "inner", F.struct(row_id, "at"))
    per = hits.groupBy(row_id).agg(F.collect_list(F.struct("at", "size", "weight")).alias("_spans"))  # bounded by the text
    both = df.join(per, row_id, "left")
    return both.withColumn(out, _by_lexicon(listed, unknown)(F.col(text), F.col("_spans"))).drop("_spans")


def _that_matter(lexicon: DataFrame) -> DataFrame:
    """Phrases of several words, and the words in them. Any other word is cut off by itself on every path."""
    known, long = lexicon.where("gram IS NOT NULL AND weight IS NOT NULL").select("gram", "size", "weight"), F.instr("gram", " ") > 0
    inside = known.where(long).select(F.explode(F.split("gram", " ")).alias("gram")).distinct()
    return known.where(long).unionByName(known.where(~long).join(inside, "gram", "left_semi"))


def _best_cuts(c: Cut, spans: list[tuple[int, np.ndarray, np.ndarray]], unknown: int) -> np.ndarray:
    """Marks each word that the best path joins to the one before. ``spans``: size, places of first words, weights.

    Words that no phrase links stand alone on every path, so the paths are those of runs of linked words. They are followed
    for many runs at once, a word of each in a step; the state is the last sums, as many as a phrase has words.
    """
    n, longest = len(c.first), max([1, *(k for k, _, _ in spans)])
    weights = [None, np.full(n, unknown, np.int64)] + [np.full(n, NEVER) for _ in range(longest - 1)]
    depth = np.zeros(n + 1, np.int32)
    for size, at, weight in spans:  # the weight stands where the phrase ends
        weights[size][at + size - 1] = weight
        if size > 1:
            depth += np.bincount(at + 1, minlength=n + 1).astype(np.int32) - np.bincount(at + size, minlength=n + 1).astype(np.int32)
    begin = np.flatnonzero(np.cumsum(depth[:n]) == 0)
    size = np.diff(np.append(begin, n))
    begin, size = begin[size > 1], size[size > 1]
    order = np.argsort(-size)
    begin, size = begin[order], size[order]
    back, sums = np.ones(n, np.int32), [np.zeros(len(begin), np.int64)] + [np.full(len(begin), NEVER) for _ in range(longest - 1)]
    active = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # runs with a word left, step by step
    for step, going in enumerate(active):
        at = begin[:going] + step
        best, chosen = sums[0][:going] + weights[1][at], np.ones(going, np.int32)
        for k in range(2, longest + 1):
            option = sums[k - 1][:going] + weights[k][at]
            better = option >= best  # of equal sums the longer phrase
            best, chosen = np.where(better, option, best), np.where(better, k, chosen)
        back[at] = chosen
        sums = [best] + [s[:going] for s in sums[:-1]]
    glue = np.zeros(n, bool)
    at, floor = begin + size - 1, begin
    while len(at):
        for k in range(2, longest + 1):
            long = at[back[at] >= k]
            glue[long - (k - 2)] = True
        at = at - back[at]
        at, floor = at[at >= floor], floor[at >= floor]
    return glue


def _by_lexicon(lexicon: DataFrame | None, unknown: int):
    """A function of texts, and of their spans of phrases found elsewhere, that joins the words of the best path."""
    shared = shared_lexicon(SparkSession.active(), lexicon)

    def joined(texts: pa.Array, found: pa.Array | None) -> pa.Array:
        parts, lo = [], 0
        for some in chunks(texts):
            c = cut(some, clauses=True)
            spans = [*shared.value.spans(c)] if shared.value is not None else []
            if found is not None:
                theirs = found.slice(lo, len(some))
                text, flat = pc.list_parent_indices(theirs).to_numpy(), theirs.flatten()
                at, size, weight = (pc.struct_field(flat, f).to_numpy() for f in ("at", "size", "weight"))
                at = at + (c.ends - np.diff(c.ends, prepend=0))[text]
                spans += [(int(k), at[size == k], weight[size == k]) for k in np.unique(size)]
            parts.append(glued(c, _best_cuts(c, spans, unknown)))
            lo += len(some)
        whole = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), whole)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return joined(texts, None)

    @F.arrow_udf("string")
    def run_with_spans(texts: pa.Array, found: pa.Array) -> pa.Array:
        return joined(texts, found)

    return lambda *columns: (run if len(columns) == 1 else run_with_spans)(*columns)
