"""URL filter by a cascade of Bloom filters (operator 1).

Rules are keys ``host + path``. The candidate keys of a url are every suffix of its host (at label borders) with every
prefix of its path whose length some rule has. All candidate keys of the corpus are the key universe. Level 1 of a
cascade is a Bloom filter of the listed keys; level 2 one of the universe keys that level 1 takes for listed although
they are not; level 3 one of the listed keys that level 2 takes for false positives; and so on until no wrong key is
left. A key is listed exactly if the first level that denies it has an even number, so a url is judged by looking at
the filters alone, without a join, and for keys of the universe without error.

There is one cascade for the blocked keys and one for the allowed keys. The longest listed key of a url decides (of two
equally long, the one with the longer host); a url without one gets the verdict ``allow``.

Only keys that pass level 1 wrongly are ever written out or shuffled, never the universe. The filters are broadcast:
their size follows from the number of rules alone (``BITS_PER_KEY`` bits a key in level 1, and every further level is
smaller), and a list that would need more than ``MAX_FILTER_BYTES`` is refused with an error.

Null or empty urls, and urls without ``://``, have an empty host and path, no candidate keys, no rule and the verdict
``allow``. Rules with a null host, path or verdict are refused, as is a key with two verdicts; repeated rules count
once. Repeated pages are judged one by one; an empty table or rule list gives an empty result or ``allow`` throughout.
Further columns of the input stay as they are; those named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicweave.llm.common import ascii_lower, query, table
from topicweave.operators.bounded import unused
from topicweave.session import staged

BITS_PER_KEY = 12
HASHES = 4
MAX_FILTER_BYTES = 256 << 20
MAX_LEVELS = 64

#: host, path, verdict
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    part = lambda n: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys under which a rule for this url could be listed, best first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.struct(
        (-(F.length(s) + n)).alias("total"), (-F.length(s)).alias("host"), F.concat(s, F.substr(path, F.lit(1), n)).alias("key")
    ))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.array_sort(keys), lambda k: k["key"])
    )


@dataclass
class Bloom:
    """Bits of one level. Positions come from two 64-bit hashes of a key, salted by the level."""

    bits: np.ndarray
    salt: int

    @property
    def n(self) -> int:
        return len(self.bits) * 8

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for at in positions(a, b, self.salt, self.n):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def positions(a: np.ndarray, b: np.ndarray, salt: int, n: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        step = (b ^ (np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
        for i in range(HASHES):
            x = a + np.uint64(i + 1) * step
            x ^= x >> np.uint64(29)
            yield (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - int(math.log2(n)))


def _hashes(df: DataFrame) -> DataFrame:
    return df.select("key", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"))


def _bloom(hashed: DataFrame, n_keys: int, salt: int) -> Bloom:
    """Build a level on the executors: bit words are combined before and after the shuffle, the driver gets the words."""
    n = 1 << max(10, math.ceil(math.log2(max(1, n_keys) * BITS_PER_KEY)))
    if n // 8 > MAX_FILTER_BYTES:
        raise ValueError(f"a filter of {n // 8} bytes is over the limit of {MAX_FILTER_BYTES}")

    def words(batches):
        for pdf in batches:
            a, b = (pdf[c].to_numpy().view(np.uint64) for c in "ab")
            at = np.concatenate([*positions(a, b, salt, n)]) if len(pdf) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"word": (at >> np.uint64(5)).astype("int64"), "bit": (np.uint64(1) << (at & np.uint64(31))).astype("int64")})

    got = hashed.mapInPandas(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(n // 32, np.uint32)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return Bloom(bits.view(np.uint8), salt)


class Cascade:
    """Exact membership of the universe's keys in one list."""

    def __init__(self, spark: SparkSession, levels: list[Bloom]):
        self.levels = spark.sparkContext.broadcast([(x.bits, x.salt) for x in levels])

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed`` and ``universe``: column ``key``, without nulls; the universe may repeat keys."""
        spark = listed.sparkSession
        right, n_right = _hashes(listed.distinct()), listed.distinct().count()
        levels: list[Bloom] = []
        if not n_right:
            return Cascade(spark, levels)
        levels.append(_bloom(right, n_right, 1))
        # the first filter runs over the whole universe; what passes wrongly is small and made unique
        passed = _passing(_hashes(universe), levels[-1]).distinct()
        wrong = staged(passed.join(right.select("key"), "key", "left_anti"), "url-false-positives")
        keep = right
        while n_wrong := wrong.count():
            if len(levels) > MAX_LEVELS:
                raise ValueError("the cascade does not end; two keys share both 64-bit hashes")
            levels.append(_bloom(wrong, n_wrong, len(levels) + 1))
            keep, wrong = wrong, staged(_passing(keep, levels[-1]), "url-false-positives")
        return Cascade(spark, levels)


def _passing(hashed: DataFrame, level: Bloom) -> DataFrame:
    cast = hashed.sparkSession.sparkContext.broadcast((level.bits, level.salt))

    def keep(batches):
        bloom = Bloom(*cast.value)
        for pdf in batches:
            yield pdf[bloom.has(*(pdf[c].to_numpy().view(np.uint64) for c in "ab"))]

    return hashed.mapInPandas(keep, "key string, a long, b long")


def _listed(levels: list[tuple[np.ndarray, int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first level that denies the key: even means listed, and so does passing an odd number of levels."""
    inside, out = np.ones(len(a), bool), np.zeros(len(a), bool)
    for i, level in enumerate(levels):
        has = inside & Bloom(*level).has(a, b)
        if i % 2 == 0:
            out |= has
        else:
            out &= ~has
        inside = has
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row. ``rules``: host, path, verdict (``allow`` or ``block``)."""
    spark = pages.sparkSession
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    rules = staged(rules.withColumn("key", F.concat("host", "path")), "url-rules")
    bad = rules.where("key IS NULL OR host = '' OR verdict IS NULL OR verdict NOT IN ('allow', 'block')")
    twice = rules.groupBy("key").count().where("count > 1")
    if bad.limit(1).count() or twice.limit(1).count():
        raise ValueError("a rule needs a host, a path and one verdict")
    # bounded by the longest rule path, whatever the number of rules
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())

    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*kept, host.alias("host"), path.alias("path"))
    universe = judged.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    lists = {v: rules.where(F.col("verdict") == v).select("key") for v in ("block", "allow")}
    cascades = {v: Cascade.build(keys, universe).levels for v, keys in lists.items()}

    names = [*kept, "host", "path"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replace the keys and their hashes by the best listed key and its verdict."""
        for batch in batches:
            keys, a, b = (batch.column(i) for i in range(len(names), len(names) + 3))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            ha, hb = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (a, b))
            block, allow = (_listed(cascades[v].value, ha, hb) for v in ("block", "allow"))
            listed = np.append(np.flatnonzero(block | allow), len(ha))
            best = listed[np.searchsorted(listed, ends[:-1])]  # keys stand best first
            found = best < ends[1:]
            flat = keys.flatten()
            rule = flat.take(pa.array(best, mask=~found))
            verdict = [("block" if block[i] else "allow") if ok else "allow" for i, ok in zip(best, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], rule.cast(pa.string()), pa.array(verdict, pa.string())], [*names, "rule", "verdict"])

    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    (at,) = unused(names, "_keys")
    keyed = judged.withColumn(at, keys)
    hashed = keyed.select(*names, at, F.transform(at, lambda k: F.xxhash64(k)), F.transform(at, lambda k: F.xxhash64(F.lit(7), k)))
    schema = StructType([*judged.select(*names).schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return hashed.mapInArrow(decide, schema)


SQL = """
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), fits AS (
  SELECT n, arg_max(struct_pack(rule := rhost || rpath, verdict := rverdict), length(rhost) + length(rpath)) AS best
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (n)
"""


@query("op1_url_filter", SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")
