"""Quality rules with thresholds learned from the corpus (operator 4).

Five counts are taken of every whole text. Two fixed base rules stay: fewer than ``MIN_WORDS`` words, and more than half
of the words inside repeated three-word windows. Everything else is judged by *adaptive* thresholds: for each language
and source, and each of four ratios, a quantile sketch gives the quartiles, and a text fails if a ratio lies beyond
``q75 + FENCE * (q75 - q25) + SLACK`` of its own group.

The sketch is a histogram over buckets whose width grows with the value (relative error at most 1/32): counting is
adding, so sketches merge in any order, over tasks, sources and languages, and give the same thresholds on every run. A
source with fewer than ``MIN_GROUP`` texts in a language takes the merged sketch of the language, a rare language that
of the corpus.

Ratios are per mille, in integers: symbols per code point in words, repeated lines per 100 words (lines in short texts),
code points per word (times 100), and repeated words per word.

Null text has no words. Null language or source form groups of their own. Empty texts fail the base rule. Repeated rows
are judged one by one and each counts in the sketch; an empty table gives an empty result. Only narrow rows of counts
are written out, joined and shuffled. Further columns of the input stay; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicweave.llm.common import drop_rows, query, table, text_key
from topicweave.operators.bounded import SALTS, small_or_none
from topicweave.session import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 50
FENCE = 3
#: per ratio: added to the upper fence, so that a group without any spread keeps ordinary texts
SLACK = {"symbols": 40, "dup_lines": 60, "word_length": 150, "repeats": 150}
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACE = b" \t\n\x0b\x0c\r"


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words inside repeated three-word windows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII white-space characters only
    spaces = len(raw) - len(raw.translate(None, SPACE))
    code_points = len(text or "") - spaces
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    code: dict[bytes, int] = {}
    ids = [code.setdefault(w, len(code)) for w in words]
    windows = [*zip(ids, ids[1:], ids[2:])]
    covered = 0
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        end = 0  # first word that no repeated window covers yet
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), code_points, symbols, len(lines) - len(set(lines)), covered


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        rows = [text_counts(x.as_py()) for x in batch.column(at)]
        cols = [*zip(*rows)] if rows else [[]] * len(COUNTS)
        kept = [c for i, c in enumerate(batch.columns) if i != at]
        names = [f.name for i, f in enumerate(batch.schema) if i != at]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int64()) for c in cols]], [*names, *COUNTS])


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The five counts of every text, beside the columns ``keep``."""
    keep = [c for c in (keep or docs.columns) if c not in COUNTS]
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text"), *(f"{c} bigint" for c in COUNTS)])
    return narrow.mapInArrow(_count_batches, schema)


def ratios() -> dict[str, Column]:
    chars, words = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words"))
    return {
        "symbols": _div(F.col("n_symbols") * 1000, chars),
        "dup_lines": _div(F.col("n_dup_lines") * 1000, words),
        "word_length": _div(F.col("word_chars") * 100, words),
        "repeats": _div(F.col("n_repeat_words") * 1000, words),
    }


def _div(top: Column, low: Column) -> Column:
    """Integer division of non-negative numbers."""
    return ((top - F.pmod(top, low)) / low).cast("bigint")


def sketch_bucket(value: Column) -> Column:
    """Bucket of a non-negative integer: the value itself below 64, else 32 buckets for each power of two."""
    size = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("bigint")
    return size * 32 + F.floor(value / F.pow(F.lit(2.0), size)).cast("bigint")


def bucket_top(bucket: Column) -> Column:
    """Largest value of a bucket."""
    size = F.greatest(_div(bucket, F.lit(32)) - 1, F.lit(0))
    return ((bucket - size * 32 + 1) * F.pow(F.lit(2.0), size)).cast("bigint") - 1


def _fences(sketch: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Sketches merged to ``keys``: number of texts and the upper fence of each ratio."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    upto = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, bucket_top(F.col("bucket"))))
    quartiles = upto.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    fence = lambda n: F.max(F.when(F.col("ratio") == n, F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + SLACK[n]))
    return quartiles.groupBy(*keys).agg(F.max("total").alias(f"n{suffix}"), *[fence(n).alias(f"{n}{suffix}") for n in SLACK])


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Upper fences of the four ratios for every (language, source) of ``counted``, and the number of its texts."""
    values = F.array(*[F.struct(F.lit(n).alias("ratio"), sketch_bucket(c).alias("bucket")) for n, c in ratios().items()])
    long = counted.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.explode(values).alias("r"))
    # the sketches of all sources; everything below works on these few rows
    sketch = staged(long.groupBy("_lang", "_source", "r.ratio", "r.bucket").agg(F.count(F.lit(1)).alias("n")), "sketches")
    corpus = _fences(sketch, [], "0").first()
    by_lang = _fences(sketch, ["_lang"], "1").withColumnRenamed("_lang", "_l")
    by_source = _fences(sketch, ["_lang", "_source"], "2")
    levels = by_source.join(by_lang, F.col("_lang").eqNullSafe(F.col("_l")), "left")
    pick = lambda n: (
        F.when(F.col("n2") >= MIN_GROUP, F.col(f"{n}2")).when(F.col("n1") >= MIN_GROUP, F.col(f"{n}1")).otherwise(F.lit(corpus[f"{n}0"]))
    )
    return levels.select("_lang", "_source", *[pick(n).cast("bigint").alias(f"max_{n}") for n in SLACK], F.col("n2").alias("n_texts"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row, beside the columns ``keep`` (default: all but the text)."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in (text, "base_failed", "kept", *COUNTS)]
    # the columns travel under numbers, so that no name of theirs can clash
    numbered = [f"c{i}" for i in range(len(keep))]
    carried = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, numbered, strict=True)], F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("text")
    )
    counted = staged(with_counts(carried, "text", [*numbered, "_lang", "_source"]), "text-counts")
    fences = staged(thresholds(counted, "_lang", "_source"), "fences")
    small = small_or_none(fences)
    on = lambda left, right: left["_lang"].eqNullSafe(right["_lang"]) & left["_source"].eqNullSafe(right["_source"])
    if small is not None:
        joined = counted.join(F.broadcast(small), on(counted, small), "left")
    else:
        # every group is copied to all salts: a source with a third of all rows still spreads over many tasks
        salted = counted.withColumn("_salt", F.pmod(F.xxhash64(*COUNTS, *numbered), F.lit(SALTS)))
        copies = fences.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, on(salted, copies) & (salted["_salt"] == copies["_copy"]), "left").drop("_salt", "_copy")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    beyond = F.lit(False)
    for name, value in ratios().items():
        beyond = beyond | (value > F.col(f"max_{name}"))
    named = [F.col(n).alias(c) for c, n in zip(keep, numbered, strict=True)]
    return joined.select(*named, *COUNTS, base.alias("base_failed"), (~(base | beyond)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``. Verdicts are joined back by id, text digest,
    language and source, on which they depend."""
    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    names = ["doc_id", "text_key", "lang", "source"]
    rejected = judge(keyed, keep=names).where("NOT kept").select(*names).distinct()
    return drop_rows(docs, staged(rejected, "rejected"), ("lang", "source"))


GROUP_SQL = """
    SELECT {keys}ratio, bucket, n, sum(n) OVER (PARTITION BY {keys}ratio ORDER BY bucket) AS upto,
           sum(n) OVER (PARTITION BY {keys}ratio) AS total
    FROM (SELECT {keys}ratio, bucket, count(*) AS n FROM longs GROUP BY ALL)"""
TOP_SQL = "(((bucket - greatest(bucket // 32 - 1, 0) * 32 + 1) << greatest(bucket // 32 - 1, 0)) - 1)"
QUART_SQL = """
  SELECT {keys}ratio, max(total) AS total, min({top}) FILTER (upto * 4 >= total) AS q1, min({top}) FILTER (upto * 4 >= total * 3) AS q3
  FROM ({group}) GROUP BY ALL"""
FENCE_SQL = """
  SELECT {keys}max(total) AS total, max(q3 + 3 * (q3 - q1) + 40) FILTER (ratio = 'symbols') AS s,
    max(q3 + 3 * (q3 - q1) + 60) FILTER (ratio = 'dup_lines') AS d, max(q3 + 3 * (q3 - q1) + 150) FILTER (ratio = 'word_length') AS w,
    max(q3 + 3 * (q3 - q1) + 150) FILTER (ratio = 'repeats') AS r
  FROM ({quart}) GROUP BY ALL"""


def _fence_sql(keys: str) -> str:
    group = GROUP_SQL.format(keys=keys)
    return FENCE_SQL.format(keys=keys, quart=QUART_SQL.format(keys=keys, top=TOP_SQL, group=group))


#: n_words, the other counts, and the verdict of every row of ``documents``
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), lines AS (
  SELECT row_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row_id
), windows AS (
  SELECT row_id, x[1] AS pos, struct_pack(a := x[2], b := x[3], c := x[4]) AS gram
  FROM (SELECT row_id, unnest(list_zip(range(len(words)), words, words[2:], words[3:], true)) AS x FROM docs)
), repeated AS (
  SELECT row_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1
), repeats AS (
  SELECT row_id, count(DISTINCT pos + k) AS n_repeat_words FROM repeated, range(3) AS t(k) GROUP BY row_id
), counted AS (
  SELECT row_id, doc_id, lang, source, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (row_id) LEFT JOIN repeats USING (row_id)
), valued AS (
  SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS v_s, 1000 * n_dup_lines // greatest(n_words, 1) AS v_d,
    100 * word_chars // greatest(n_words, 1) AS v_w, 1000 * n_repeat_words // greatest(n_words, 1) AS v_r FROM counted
), pairs AS (
  SELECT lang, source, unnest([{{'ratio': 'symbols', 'v': v_s}}, {{'ratio': 'dup_lines', 'v': v_d}}, {{'ratio': 'word_length', 'v': v_w}}, {{'ratio': 'repeats', 'v': v_r}}]) AS p FROM valued
), longs AS (
  SELECT lang, source, p.ratio AS ratio, greatest(length(bin(p.v)) - 6, 0) * 32 + (p.v >> greatest(length(bin(p.v)) - 6, 0)) AS bucket FROM pairs
), f2 AS ({_fence_sql("lang, source, ")}), f1 AS ({_fence_sql("lang, ")}), f0 AS ({_fence_sql("")}), joined AS (
  SELECT v.*, CASE WHEN f2.total >= 50 THEN f2.s WHEN f1.total >= 50 THEN f1.s ELSE f0.s END AS max_s,
    CASE WHEN f2.total >= 50 THEN f2.d WHEN f1.total >= 50 THEN f1.d ELSE f0.d END AS max_d,
    CASE WHEN f2.total >= 50 THEN f2.w WHEN f1.total >= 50 THEN f1.w ELSE f0.w END AS max_w,
    CASE WHEN f2.total >= 50 THEN f2.r WHEN f1.total >= 50 THEN f1.r ELSE f0.r END AS max_r
  FROM valued v JOIN f2 ON v.lang IS NOT DISTINCT FROM f2.lang AND v.source IS NOT DISTINCT FROM f2.source
    JOIN f1 ON v.lang IS NOT DISTINCT FROM f1.lang, f0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR v_s > max_s OR v_d > max_d OR v_w > max_w OR v_r > max_r) AS kept
FROM joined
"""


@query("op4_quality_rules", SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("lang", "source")
