"""How far the sources of a language differ in their terms (operator 11), over terms found by Iceberg prefix refinement.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that occur
in at least ``MIN_DOCS`` of its documents. Most terms of a web corpus occur once or twice, so they are not counted term by
term: prefixes of ``FIRST_LEVEL`` bytes are counted first, and only prefixes with ``MIN_DOCS`` distinct documents are
extended, to twice their length at each further level. A term that is complete at a level leaves the refinement there,
kept if it reached the threshold itself. Rare terms fall out early, with prefixes that they share, and are never moved.

The texts are read once. A task folds whole documents into rows of two kinds: per (language, source, term) the occurrences
and the number of documents, and per (language, prefix), for each level, the number of distinct documents that have a
longer term with this prefix. No document is in two folds, so all of these numbers are exact when they are added. A
fold numbers its terms and counts by sorting numbers. The rows are written where they arise. Each level reads those of its length, without the ones whose prefix fell out before:
a bitmap of fixed size takes them away, and what slips through fails the count, since an extension has no more documents
than its prefix.

Shares are whole numbers per 10^9, ``p = 1 + floor(10^9 (count + 1) / (N + V))``, and ``(p - q)^2 / q``, rounded down, is
how far a source's share p of a term is from another one's q. For pairs of sources it is summed over all kept terms,
those with no occurrence included: terms are dealt over buckets, and each bucket adds up a matrix of (``BLOCK`` sources x
all sources of the language) instead of making rows for pairs. Against the whole language, the first ``TOP`` terms of each
source are ranked, within salts first.

Null text, language and source count as empty. Each row is a document, repeated ids and texts too. Very long terms are
terms like others. A language without kept terms has pairs of value 0; an empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicweave.llm.common import query, table
from topicweave.llm.packing import CUT_BYTES, FIRST_BYTES, CutTable
from topicweave.operators.bounded import SALTS, join_lookup, maybe_in
from topicweave.session import staged

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
FIRST_LEVEL = 4
#: words of whole documents that a fold holds before it gives its rows
MAX_ENTRIES = 2_000_000
SLICE_BYTES = 1 << 20
BLOCK = 512
BUCKET_ENTRIES = 200_000
CELLS = 1 << 20
#: bytes up to 7F that are no letters end a term; A-Z become a-z
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Fold:
    """Occurrences and document counts of the terms and prefixes of whole documents, in bounded memory.

    Terms get numbers, in order of arrival: by a table those of at most ``CUT_BYTES`` bytes, by a dictionary the others.
    """

    def __init__(self) -> None:
        self.table, self.long = CutTable(), {}
        self.groups: dict[tuple[str, str], int] = {}
        self.group_of: list[int] = []  # of each document
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # documents and terms, long ones as -1 - number
        self.words = 0

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        table, before = self.table, len(self.group_of)
        self.group_of += [self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)]
        whole = (b" ".join([b"", *texts, b""]) + b" " * 25).translate(TO_TERMS)
        data = np.frombuffer(whole, np.uint8)
        inside = data != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a space is first and last
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            return
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = before + np.searchsorted(ends, starts, "left")
        short = np.flatnonzero(sizes <= CUT_BYTES)
        keys = table.keys_of(data, starts[short], sizes[short])
        term = np.zeros(len(starts), np.int64)
        entry = table.find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            order, head = _same_rows(keys[missing])
            k = keys[missing[order[head]]]
            entry[missing[order]] = table.add(k, np.zeros(0, np.uint32), np.zeros(len(k), np.int64))[np.cumsum(head) - 1]
        term[short] = entry
        for i in np.flatnonzero(sizes > CUT_BYTES).tolist():
            at = int(starts[i])
            term[i] = -1 - self.long.setdefault(whole[at : at + int(sizes[i])], len(self.long))
        self.parts.append((doc.astype(np.int32), term.astype(np.int32)))
        self.words += len(doc)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        n, long = self.table.n, [*self.long]
        keys = np.concatenate([self.table.keys[:n], np.frombuffer(b"".join(t[:24] for t in long), np.uint64).reshape(-1, 3)])
        sizes = np.concatenate([(self.table.keys[:n, 2] >> np.uint64(56)).astype(np.int64), np.fromiter(map(len, long), np.int64, len(long))])
        doc, term = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts, strict=True))
        self.parts = []
        group_of, names = np.asarray(self.group_of), [*self.groups]

        term[term < 0] = n - 1 - term[term < 0]
        key, count = _counted(group_of[doc] << 32 | term)
        pairs, _ = _counted(doc << 32 | term)
        doc, term = pairs >> 32, pairs & 0xFFFFFFFF
        _, docs = _counted(group_of[doc] << 32 | term)  # the same keys
        g, t = key >> 32, key & 0xFFFFFFFF
        for lo, hi in _stretches(g):
            lang, source = names[g[lo]]
            yield _rows(lang, source, _bytes_of(keys, sizes, t[lo:hi], n, long), count[lo:hi], docs[lo:hi])

        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in names))}
        lang_of, known = np.asarray([langs[lang] for lang, _ in names])[group_of], [*langs]
        level = FIRST_LEVEL
        while len(doc):
            more = sizes[term] > level
            doc, term = doc[more], term[more]
            if not len(doc):
                break
            used = np.flatnonzero(np.bincount(term, minlength=len(sizes)))
            number = np.zeros(len(sizes), np.int64)
            if level <= 16:
                heads = np.zeros((len(used), 3), np.uint64)
                for k in range(2):
                    heads[:, k] = keys[used, k] & FIRST_BYTES[min(max(level - 8 * k, 0), 8)]
                same, head = _same_rows(heads)
                number[used[same]] = np.cumsum(head) - 1
                prefixes = _bytes_of(heads, np.full(len(heads), level), same[head], len(heads), [])
            else:  # terms of the dictionary only
                found: dict[bytes, int] = {}
                number[used] = [found.setdefault(long[i - n][:level], len(found)) for i in used.tolist()]
                prefixes = pa.array([*found], pa.binary())
            once, _ = _counted(doc << 32 | number[term])
            key, docs = _counted(lang_of[once >> 32] << 32 | once & 0xFFFFFFFF)
            for lo, hi in _stretches(key >> 32):
                yield _rows(known[key[lo] >> 32], None, prefixes.take(pa.array(key[lo:hi] & 0xFFFFFFFF)), None, docs[lo:hi])
            level *= 2


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each is there; ``values`` are sorted in place."""
    values.sort()
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[at], np.diff(at, append=len(values))


def _same_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows that puts equal ones together, and which of them are the first of their kind."""
    order = np.lexsort((keys[:, 0], keys[:, 1], keys[:, 2]))
    k = keys[order]
    return order, np.r_[True, (k[1:] != k[:-1]).any(axis=1)]


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place, exclusive, of each run of equal values."""
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return zip(at.tolist(), [*at[1:].tolist(), len(values)], strict=True)


def _bytes_of(keys: np.ndarray, sizes: np.ndarray, term: np.ndarray, n: int, long: list[bytes]) -> pa.Array:
    """The terms of these numbers: below ``n`` from the bytes of their keys."""
    if (term >= n).any():
        held = _bytes_of(keys, sizes, term[term < n], n, long).to_pylist()
        held = iter(held)
        return pa.array([next(held) if t < n else long[t - n] for t in term.tolist()], pa.binary())
    size = sizes[term]
    flat = keys[term].astype("<u8", copy=False).view(np.uint8).reshape(-1, 24)[np.arange(24) < size[:, None]]
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(term), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def _rows(lang: str, source: str | None, terms: pa.Array, count: np.ndarray | None, docs: np.ndarray) -> pa.RecordBatch:
    n = len(terms)
    cols = [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), terms]
    cols += [pa.nulls(n, pa.int64()) if count is None else pa.array(count, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = _Fold()
    for batch in batches:
        lang, source, lo, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, []
        room = SLICE_BYTES
        for i, text in enumerate(batch.column(2)):
            held.append(text.as_py().encode("utf-8", "surrogatepass"))
            room -= len(held[-1])
            if room < 0 or i + 1 == batch.num_rows:
                fold.add(lang[lo : i + 1], source[lo : i + 1], held)
                lo, held, room = i + 1, [], SLICE_BYTES
                if fold.words > MAX_ENTRIES:
                    yield from fold.rows()
                    fold = _Fold()
    yield from fold.rows()


def folded_terms(docs: DataFrame) -> DataFrame:
    """Rows of both kinds for ``docs`` (lang, source, text); those of prefixes have no source and no ``n``."""
    return docs.select("lang", "source", "text").mapInArrow(_fold_batches, "lang string, source string, term binary, n bigint, docs bigint")


def refine(folded: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """Kept terms (``lang``, ``term``), level by level."""
    rows = folded.select("lang", "term", F.col("n").isNotNull().alias("whole"), "docs", F.octet_length("term").alias("size"))
    level, kept, alive = FIRST_LEVEL, None, None
    while True:
        ends = F.col("whole") & F.col("size").between(level // 2 + 1 if alive is not None else 1, level)
        here = rows.where(ends | (~F.col("whole") & (F.col("size") == level)))
        if alive is not None:
            here = maybe_in(here.withColumn("key", F.xxhash64("lang", F.substring("term", 1, level // 2))), alive, "key")
        reached = here.groupBy("lang", "term", "whole").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        reached = staged(reached.select("lang", "term", "whole"), f"prefixes-{level}")
        whole = reached.where("whole").select("lang", "term")
        kept = whole if kept is None else kept.union(whole)
        alive = reached.where("NOT whole").select(F.xxhash64("lang", "term").alias("key"))
        if alive.isEmpty():
            return kept
        level *= 2


def kept_counts(folded: DataFrame, kept: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` of the kept terms, and ``n_lang`` over all sources of the language.

    A bitmap takes most other terms away; what slips through fails the count of documents, as in the refinement. All
    steps meet in one shuffle by language and term."""
    whole = folded.where("n IS NOT NULL").select("lang", "source", "term", "n", "docs", F.xxhash64("lang", "term").alias("key"))
    near = maybe_in(whole, kept.select(F.xxhash64("lang", "term").alias("key")), "key").drop("key").repartition("lang", "term")
    summed = near.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source
    exact = summed.withColumns({"n_lang": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    return exact.where(F.col("lang_docs") >= least).drop("docs", "lang_docs")


def source_totals(groups: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Per group: ``total`` occurrences of kept terms, those of the language (``lang_total``), the number of kept terms ``v``,
    and the number ``no`` of the source among the ``sources`` of its language."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    known = groups.join(own, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "entries", "v"])
    lang = Window.partitionBy("lang")
    return known.withColumns({
        "lang_total": F.sum("total").over(lang), "lang_entries": F.sum("entries").over(lang),
        "sources": F.count(F.lit(1)).over(lang), "no": F.row_number().over(lang.orderBy("source")) - 1,
    })


def share(count: Column, total: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + v))``, in whole numbers of 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + v))


def _matrix_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over a bucket's terms of the distance of each source of a block from each source of the language."""
    block = key[1].as_py()
    order = np.argsort(right["no"].to_numpy())
    total, v = right["total"].to_numpy()[order].astype(object), int(right["v"][0].as_py())
    none = np.array([1 + SCALE // (int(t) + v) for t in total], np.int64)  # share of a term that does not occur
    lo, hi = block * BLOCK, min((block + 1) * BLOCK, len(none))
    sums = np.zeros((hi - lo, len(none)), np.int64)
    if left.num_rows:
        codes = pc.dictionary_encode(left["term"].combine_chunks()).indices.to_numpy()
        sort = np.argsort(codes, kind="stable")
        codes, no, p = codes[sort], left["no"].to_numpy()[sort], left["p"].to_numpy()[sort]
        step = max(1, CELLS // len(none))
        for first in range(0, int(codes[-1]) + 1, step):
            a, b = np.searchsorted(codes, [first, first + step])
            shares = np.tile(none, (min(step, int(codes[-1]) + 1 - first), 1))
            shares[codes[a:b] - first, no[a:b]] = p[a:b]
            for i in range(lo, hi):
                apart = shares[:, i : i + 1] - shares
                sums[i - lo] += (apart * apart // shares).sum(axis=0)
    one, other = np.divmod(np.arange(sums.size), len(none))
    return pa.table({"lang": pa.array([key[0].as_py()] * sums.size, pa.string()), "one": one + lo, "other": other, "value": sums.ravel()})


def pair_values(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, source numbers ``one`` and ``other``, ``value``: for languages with kept terms, also of a source and itself."""
    known = totals.where("v > 0")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("sources") - 1) / BLOCK), F.lit(1).cast("bigint"))
    buckets = F.floor(F.col("lang_entries") / BUCKET_ENTRIES) + 1
    left = join_lookup(counts, known.select("lang", "source", "no", "total", "v", "sources", buckets.alias("buckets")), ["lang", "source"], "inner", spread=F.col("term"))
    left = left.select("lang", "term", "no", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), F.explode(blocks).alias("block"), F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1, F.lit(1).cast("bigint")))
    right = known.select("lang", "no", "total", "v", "lang_entries", F.explode(blocks).alias("block")).withColumn("bucket", every)
    on = ["lang", "block", "bucket"]
    sums = left.groupBy(*on).cogroup(right.select("lang", "no", "total", "v", "block", "bucket").groupBy(*on))
    sums = sums.applyInArrow(_matrix_sums, "lang string, one bigint, other bigint, value bigint")
    return sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank; see the module."""
    names = {"lang": lang, "source": source, "text": text}
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in names.items()])
    folded = staged(folded_terms(narrow), "terms")
    kept = staged(refine(folded), "kept-terms")
    counts = staged(kept_counts(folded, kept), "term-counts")
    totals = staged(source_totals(narrow.select("lang", "source").distinct(), counts, kept), "source-totals")

    # every source against each other source of its language
    one = totals.select("lang", "source", F.col("no").alias("one"))
    other = totals.select("lang", F.col("source").alias("item"), F.col("no").alias("other"))
    pairs = one.join(other, "lang").where("one <> other").join(pair_values(counts, totals), ["lang", "one", "other"], "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = [F.desc("value"), F.asc("item")]
    group = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(*order)))

    # every source against its language
    known = join_lookup(counts, totals.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"], "inner", spread=F.col("term"))
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("n_lang"), F.col("lang_total"), F.col("v"))
    more = known.select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = more.select("lang", "source", "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    salted = terms.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= TOP)
    best = few.drop("salt").withColumn("rank", F.row_number().over(group.orderBy(*order))).where(F.col("rank") <= TOP)

    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", best))]
    return parts[0].union(parts[1])


SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), words AS (SELECT lang, source, doc, unnest(words) AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 3
), counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs
), langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), totals AS (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), lang_totals AS (SELECT lang, CAST(sum(total) AS HUGEINT) AS total FROM totals GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + l.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN totals t USING (lang, source) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
), lang_shares AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(t.total) + any_value(l.v)) AS q
  FROM counts JOIN lang_totals t USING (lang) JOIN langs l USING (lang) GROUP BY ALL
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""


@query("op11_divergence", SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
