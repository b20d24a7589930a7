"""Benchmark decontamination by spaced seeds (operator 5). DataFrame functions only.

Texts become words: lower case, cut at everything that is no letter, mark or digit; each character of a script that is
written without spaces is a word of its own. A seed is a fixed mask over a
window of words: positions marked 1 are hashed together, positions marked 0 are ignored, so a hit survives a changed word
at an ignored position. No overlap that passes the comparison below is without a hit: each length of window has masks for
every choice of words that may differ, and masks of windows under 13 words are used only if there are items that short.
Seed hashes of the benchmark are joined with those of the documents; a hit names a document, an
item and a shift between both. Around every hit the words of the two texts are then compared one by one along that shift,
and the document is contaminated by the item if some ``WINDOW`` words in a row (all, if the item is shorter) agree in at
least ``MIN_SIMILARITY`` of the positions.

The documents' seeds are never shuffled as long as the benchmark's seeds can be broadcast (``MAX_SEEDS``); beyond that
both sides are shuffled by hash, documents' seeds filtered to the benchmark's hashes first. Hits are folded to one row per
(document, item, shift) before they move. Word lists are cut into chunks before seeds are made, so a very long text needs
no more memory than its words.

Items of fewer than ``MIN_LEAK`` words are one seed of their own length and match where all their words stand in a row. So
few words say little about a leak: ``drop_contaminated`` heeds them only if the document has no other words.

Null and empty texts and items have no words, hence no hits. Rows are named by (doc_id, text digest), null-safe; repeated rows give repeated results. Empty
tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import drop_rows, query, table, text_key
from topicweave.operators.bounded import maybe_in, small_or_none
from topicweave.session import staged

#: fixed masks by the number of words that are compared; 1: the word counts, 0: any word. Whatever words may differ
#: (2 of 13 to 10 words, 1 of 9 to 7), one of the masks fits between them: tests enumerate the patterns
MASKS = {
    13: ["11110111", "1110110011", "11010010111"],
    12: ["11101011", "11010111", "1110010011"],
    11: ["1111011", "110001111", "1101100011"],
    10: ["111011", "1101011", "1110011"],
    9: ["1111011", "1101111"],
    8: ["111111", "1101111", "1111011"],
    7: ["11111", "110111", "111101"],
    **{n: ["1" * n] for n in range(6, 0, -1)},
}
MIN_LEAK = 7
WINDOW = 13
MIN_SIMILARITY = 0.8
CHUNK = 2048
MAX_SEEDS = 2_000_000
#: no letter, mark or digit; the ASCII part stands first, since it decides most characters
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F[^\x00-\x7F\p{L}\p{M}\p{N}]]+"
#: scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana and Han
UNSPACED = r"[\x{E00}-\x{10FFFF}&&[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]]"


def words(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    wide = (F.octet_length(low) > F.length(low)) & F.regexp_like(low, F.lit(UNSPACED))
    apart = F.when(wide, F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    return F.array_remove(F.split(apart, BREAKS), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """``keep``, ``pos`` (0-based) and ``seed`` for every mask at every position of ``_hashes``.

    The list is cut into overlapping chunks; within one, shifted copies are zipped, so a row of neighbouring words as long
    as the longest mask comes out of plain array functions and the hashing runs in generated code.
    """
    span = max(map(len, masks))
    n = F.size("_hashes")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(CHUNK))
    chunks = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice(F.col("_hashes"), s + 1, F.lit(CHUNK + span - 1)).alias("c")))
    cut = rows.select(*keep, F.explode(chunks).alias("k")).select(*keep, F.col("k.s").alias("_s"), F.col("k.c").alias("_c"))
    shifted = [F.slice("_c", F.lit(i + 1), F.least(F.size("_c"), F.lit(CHUNK))).alias(f"w{i}") for i in range(span)]
    zipped = cut.select(*keep, "_s", F.posexplode(F.arrays_zip(*shifted)).alias("_i", "_w"))
    zipped = zipped.where(F.col("_i") < CHUNK)
    hashes = []
    for mask in masks:
        taken = [F.col(f"_w.w{i}") for i, bit in enumerate(mask) if bit == "1"]
        last = F.col(f"_w.w{len(mask) - 1}")  # null where the mask runs over the end
        hashes.append(F.when(last.isNotNull(), F.xxhash64(F.lit(mask), *taken)))
    out = zipped.select(*keep, (F.col("_s") + F.col("_i")).alias("pos"), F.explode(F.array(*hashes)).alias("seed"))
    return out.where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs`` and item that contaminates it: doc_id, text_key, item_id, ``matched`` words in the best
    window, the ``window`` length, and ``doc_words``."""
    items = benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("_hashes"))
    items = staged(items.select("item_id", F.xxhash64("_hashes").alias("_item"), "_hashes").distinct(), "items")
    rows = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    lengths = items.select(F.least(F.size("_hashes"), F.lit(WINDOW)).alias("n")).where("n > 0").distinct()
    lengths = sorted(r.n for r in lengths.collect()) or [WINDOW]  # 13 at most
    listed = [seeds(items.where(F.least(F.size("_hashes"), F.lit(WINDOW)) == n), ["_item"], MASKS[n]) for n in lengths]
    listed = reduce(DataFrame.union, listed).select("seed", "_item", F.col("pos").alias("ipos")).distinct()
    small = small_or_none(listed, MAX_SEEDS)
    masks = sorted({m for n in lengths for m in MASKS[n]})
    found = seeds(rows.select("_id", "_key", word_hashes(F.col("_text")).alias("_hashes")), ["_id", "_key"], masks)
    if small is not None:
        hits = found.join(F.broadcast(small), "seed")
    else:
        listed = staged(listed, "benchmark-seeds")
        # a bitmap takes most seeds out of the shuffle
        hits = maybe_in(found, listed.select("seed"), "seed").join(listed, "seed")
    shifts = hits.select("_id", "_key", "_item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    shifts = staged(shifts, "seed-hits")

    # verification: only documents with a hit are read again
    hit_rows = shifts.select(F.col("_id").alias("_hid"), F.col("_key").alias("_hkey")).distinct()
    may = maybe_in(rows, shifts.select("_key"), "_key")
    again = may.join(hit_rows, may["_id"].eqNullSafe(F.col("_hid")) & (may["_key"] == F.col("_hkey")), "left_semi")
    again = staged(again.select("_id", "_key", word_hashes(F.col("_text")).alias("_words")), "hit-documents")
    by_item = shifts.join(items.select("_item", "_hashes").dropDuplicates(["_item"]), "_item")
    by_item = by_item.select(F.col("_id").alias("_sid"), F.col("_key").alias("_skey"), "_item", "shift", "_hashes")
    both = again.join(by_item, again["_id"].eqNullSafe(by_item["_sid"]) & (again["_key"] == by_item["_skey"]))
    size = F.size("_hashes")
    window = F.least(size, F.lit(WINDOW))
    # the document's words along the shift, null where the item reaches over its edge
    left = F.greatest(-F.col("shift"), F.lit(0))
    begin = F.greatest(F.col("shift"), F.lit(0))
    length = F.greatest(F.least(size - left, F.size("_words") - begin), F.lit(0))
    agree = F.zip_with(F.slice("_hashes", left + 1, length), F.slice("_words", begin + 1, length), lambda a, b: (a == b).cast("int"))
    starts = F.when(F.size("_agree") >= F.col("_window"), F.sequence(F.lit(1), F.size("_agree") - F.col("_window") + 1)).otherwise(F.array().cast("array<int>"))
    add = lambda acc, x: acc + x
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(F.col("_agree"), s, F.col("_window")), F.lit(0), add)))
    doc_words = F.size("_words").alias("doc_words")
    scored = both.select("_id", "_key", "_item", doc_words, window.alias("_window"), agree.alias("_agree")).select("_id", "_key", "_item", "doc_words", "_window", best.alias("matched"))
    need = F.when(F.col("_window") < MIN_LEAK, F.col("_window")).otherwise(F.ceil(F.col("_window") * MIN_SIMILARITY))
    good = scored.where(F.col("matched") >= need)
    per = good.groupBy("_id", "_key", "_item").agg(F.max("matched").alias("matched"), F.max("_window").alias("window"), F.max("doc_words").alias("doc_words"))
    names = items.select("item_id", "_item")
    few = small_or_none(names)
    named = per.join(names if few is None else F.broadcast(few), "_item")
    return named.select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_key"), "item_id", "matched", "window", "doc_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; a short item counts only if it is all of a document."""
    found = overlaps(docs, benchmark).where((F.col("window") >= MIN_LEAK) | (F.col("window") == F.col("doc_words")))
    return drop_rows(docs, staged(found.select("doc_id", "text_key").distinct(), "contaminated"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("bigint").alias("matched"), F.col("window").cast("bigint").alias("window"))
