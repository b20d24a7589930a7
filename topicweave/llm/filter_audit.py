"""How filters interact: every order of applying them, from one table of failure masks (operator 13).

A document fails some subset of the filters, its mask. What an order of filters removes at each step depends on masks
alone, so all documents of a part fold into at most ``2 ** len(FILTERS)`` counts, and everything else happens on the
lattice of subsets: a state is the set of filters applied so far, an edge applies one more. An edge removes the documents
that fail its filter and none of its state's.

Forward counting gives the orders that reach each state, backward counting those that lead from it to the end; an edge
lies on (orders that reach its start) x (orders that leave its end) orders. Removals weighted so and summed over the edges
of a filter are its Shapley value (times the number of orders, in whole numbers). The steps of each single order are read
from the same edges.

The texts are read once, by Arrow batches, and leave narrow rows: part, id, failure bits, digest. Whether a smaller id has
the same text is found by joining (digest, id) with the smallest id per digest, after equal rows have been folded: no key
of that join is hot, however many copies a text has. Labels are joined once per (part, mask, id).

Null text counts as empty, a null source is the part of the empty string. A null id is neither smaller nor larger than
another: such rows never fail the copy filter and have no labels. Rows that repeat an id and a text are judged alike. Of
several labels of an id, one that is 1 is enough. Very long texts need memory for their words only. An empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import query, table
from topicweave.session import staged

#: the filters by letter; the last one needs the whole table
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")


def text_failures(text: str | None) -> tuple[int, bytes]:
    """Bits of the filters that need one text only, and a 128-bit digest of the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII white-space characters only
    upper = len(raw) - len(raw.translate(None, UPPER))
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * upper > MAX_UPPER_PERCENT * len(text or ""),
        len(raw.translate(None, SYMBOLS)) < len(raw),
    )
    return sum(1 << i for i, bad in enumerate(failed) if bad), xxhash.xxh3_128_digest(raw)


def _failure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_failures(x.as_py()) for x in batch.column(2)]
        bits = pa.array([b for b, _ in found], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits, pa.array([d for _, d in found], pa.binary())], ["part", "doc_id", "bits", "digest"])


def failure_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``part``, ``doc_id``, ``mask`` of failed filters and the number ``n`` of such rows."""
    narrow = docs.select(F.coalesce(F.col(source), F.lit("")).alias("part"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = narrow.mapInArrow(_failure_batches, f"part string, doc_id {kind}, bits int, digest binary")
    rows = staged(rows.groupBy("part", "doc_id", "bits", "digest").agg(F.count(F.lit(1)).alias("n")), "failures")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), COPY).otherwise(0)
    known = rows.join(first, ["digest", "doc_id"], "left")
    return known.groupBy("part", "doc_id", F.col("bits").bitwiseOR(copy).alias("mask")).agg(F.sum("n").alias("n"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` and the numbers ``n``, ``good``, ``toxic`` of documents: at most 32 rows for each part."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("bigint")).alias(c)
    by_id = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    known = masks.join(by_id, "doc_id", "left")
    sums = {"n": F.col("n"), "good": F.col("n") * F.coalesce("quality", F.lit(0)), "toxic": F.col("n") * F.coalesce("toxic", F.lit(0))}
    return known.groupBy("part", "mask").agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def path_counts(n: int) -> tuple[dict[int, int], dict[int, int]]:
    """Numbers of orders that reach every state from the empty one, and that lead from it to the full one."""
    full = (1 << n) - 1
    reach, leave = {0: 1}, {full: 1}
    for state in range(full + 1):  # a state follows all its subsets
        for i in range(n):
            if not state >> i & 1:
                reach[state | 1 << i] = reach.get(state | 1 << i, 0) + reach[state]
    for state in range(full, -1, -1):
        for i in range(n):
            if state >> i & 1:
                leave[state ^ 1 << i] = leave.get(state ^ 1 << i, 0) + leave[state]
    return reach, leave


def edges(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, number of orders over this edge) for every edge of the lattice."""
    reach, leave = path_counts(n)
    return [(s, i, reach[s] * leave[s | 1 << i]) for s in range(1 << n) for i in range(n) if not s >> i & 1]


def _structs(rows: list[tuple], names: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, row, strict=True)]) for row in rows])


def edge_counts(histogram: DataFrame) -> DataFrame:
    """Per part and edge (``state``, ``filter``): documents ``kept``, ``removed``, ``redundant``, the labelled ones among
    the removed, ``unique_fails`` of the filter, and ``weighted`` removals."""
    listed = _structs(edges(len(FILTERS)), ["state", "filter", "orders"])
    pairs = histogram.select("part", "mask", "n", "good", "toxic", F.explode(listed).alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    alive = F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0))
    sums = {
        "kept": total("n", alive & ~fails), "removed": total("n", alive & fails), "redundant": total("n", ~alive & fails),
        "unique_fails": total("n", F.col("mask") == bit), "good_lost": total("good", alive & fails), "toxic_lost": total("toxic", alive & fails),
    }
    counted = pairs.groupBy("part", "state", "filter", "orders").agg(*[c.alias(name) for name, c in sums.items()])
    return counted.withColumn("weighted", F.col("removed") * F.col("orders"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    histogram = staged(mask_counts(failure_masks(docs, doc_id, text, source), labels), "mask-counts")
    found = staged(edge_counts(histogram), "edges")  # 80 rows for each part
    values = found.groupBy("part", "filter").agg(F.sum("weighted").alias("shapley"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        names = "".join(FILTERS[i] for i in order)
        steps += [(names, k + 1, reduce(lambda s, i: s | 1 << i, order[:k], 0), order[k]) for k in range(len(order))]
    step_table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")  # 600 rows
    out = found.join(F.broadcast(step_table), ["state", "filter"]).join(values, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: masks of all documents, then every order step by step
SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), fails AS (
  SELECT part, doc_id,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS failed FROM docs
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), hist AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, left(filter_order, step - 1) AS before FROM orders, range(1, 6) AS t(step)
), counted AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN translate(failed, before || letter, '') = failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM hist, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""


@query("op13_filter_audit", SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
