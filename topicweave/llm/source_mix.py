"""Mixing sources to target weights by blocks (operator 12).

The documents of a source form one stream of words, cut into blocks of ``BLOCK`` words; the last block may be shorter. The
mix is a table of slots, dealt over output shards of ``SHARD_SLOTS`` slots. Every shard draws how many of its slots each
source gets from a multinomial distribution. The slots of a source are numbered through all shards; slot number r takes
the block that a pseudorandom permutation of the source's block numbers (a Feistel network, another one for each pass over
the source) puts at place r. Slots and blocks then join by (source, block).

A multinomial draw only comes near its expectation, and a source that may be used twice must not be used a third time. So
each source has a quota of slots, whole passes and the rest of its target. Slots drawn beyond the quota go, in order, to
the sources whose draws stayed short of theirs, and the last slot of a source takes only the words that are left. What a
source gives is its target rounded down, to the word, and no block is used more often than passes have begun.

Targets: sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a target
stops at ``MAX_PASSES`` times its source's words, and what is beyond is shared again among the others by weight. All of it
is done in whole numbers.

The order of a stream is fixed by hashes of (id, text digest); equal rows stand side by side, folded into one row with
their number until places are known, so neither partitions nor retries change the result. One row per source is held by
the driver and by each drawing task; everything that grows with documents or words stays in Spark. A source with a third
of all rows spreads over ``BUCKETS`` buckets of its stream and over the hash of (source, block).

Null text has no words; documents without words are in no block and give 0 words. Null ids are ids like others. A null
source is a source of its own. An empty table, or one without words, gives targets of 0. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import query, table, text_key
from topicweave.operators.bounded import counted_join
from topicweave.operators.ranking import running_sums
from topicweave.session import staged

#: the contract's weights, share of all words and limit of passes
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
MAX_PASSES = 2
BLOCK = 128
SHARD_SLOTS = 4096
BUCKETS = 1024
SHARD_BUCKET = 1024
COPIES = 4096
SEED = 42
ROUNDS = 6
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class Quota:
    """What the mix takes of one source: ``words`` in ``slots`` slots, of which the last one gives ``last`` words."""

    size: int
    target: float
    words: int
    blocks: int
    slots: int
    last: int


def _round_value(right: np.ndarray, key: np.ndarray, turn: int, half: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (right + key * _MIX[0] + np.uint64(turn + 1) * _MIX[1]) * _MIX[2]
        x ^= x >> np.uint64(29)
        x *= _MIX[1]
        x ^= x >> np.uint64(32)
    return x & ((np.uint64(1) << half) - np.uint64(1))


def permute(place: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 chosen by ``key``, element by element: a Feistel network over the next power of four,
    followed until it lands below n. ``back`` inverts it."""
    x, n, key = (np.asarray(v).astype(np.uint64) for v in (place, n, key))
    half = np.ones(len(x), np.uint64)
    while (small := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[small] += np.uint64(1)
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ _round_value(a, k, turn, h), a
            else:
                a, b = b, a ^ _round_value(b, k, turn, h)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def pass_key(source: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Key of the permutation of a source's blocks in a pass."""
    return (np.asarray(source, np.uint64) << np.uint64(8)) + np.asarray(turn, np.uint64) + np.uint64(SEED << 40)


def share_words(sizes: list[int]) -> list[tuple[int, int]]:
    """Target of each source as a fraction (top, low), for sizes in the order of the sources."""
    weight = [w for w, _ in zip(cycle(WEIGHTS), sizes)]
    full: set[int] = set()
    top, low = SHARE[0] * sum(sizes), SHARE[1]  # the words to share are top / low
    while True:
        left = top - low * MAX_PASSES * sum(sizes[i] for i in full)
        total = sum(w for i, w in enumerate(weight) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and weight[i] * left > MAX_PASSES * sizes[i] * low * total}
        if not over:
            return [(MAX_PASSES * n, 1) if i in full else (weight[i] * left, low * total) for i, n in enumerate(sizes)]
        full |= over


def quotas(sizes: list[int], block: int = BLOCK) -> list[Quota]:
    out = []
    for i, (size, (top, low)) in enumerate(zip(sizes, share_words(sizes), strict=True)):
        words, blocks = top // low if low else 0, -(-size // block)
        passes, rest = divmod(words, size) if size else (0, 0)
        slots, last = passes * blocks, 0
        if passes and not rest:
            # the last slot of the last pass
            end = int(permute([blocks - 1], [blocks], pass_key([i], [passes - 1]))[0])
            last = min(block, size - end * block)
        if rest:
            # the short block comes at some place of the pass that is not complete
            short = int(permute([blocks - 1], [blocks], pass_key([i], [passes]), back=True)[0])
            lack = blocks * block - size
            used = -(-rest // block)
            if used > short:
                used = max(short + 1, -(-(rest + lack) // block))
            before = (used - 1) * block - (lack if used - 1 > short else 0)
            slots, last = slots + used, rest - before
        out.append(Quota(size, top / low if low else 0.0, words, blocks, slots, last))
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``docs`` (source, doc_id, text) with ``size``, the number of words, and a digest in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len((x.as_py() or "").encode("utf-8", "surrogatepass").split()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], ["source", "doc_id", "key", "size"])

    narrow = docs.select("source", "doc_id", text_key(F.col("text")).alias("key"), "text")
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"source {kinds['source']}, doc_id {kinds['doc_id']}, key bigint, size bigint")


def _draws(shares: np.ndarray, slots: int):
    """Rows (shard, source, n): how many slots of each shard a source is drawn for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(SHARD_SLOTS, slots - shard * SHARD_SLOTS)
                drawn = np.random.Generator(np.random.PCG64([SEED, shard])).multinomial(n, shares)
                some = np.flatnonzero(drawn)
                first = np.cumsum(drawn[some]) - drawn[some]
                cols = [np.full(len(some), shard), some, drawn[some], first]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["shard", "source", "n", "first"])

    return run


def _slot_batches(found: list[Quota], drawn: np.ndarray, slots: int):
    """Slots of drawn runs: place in the shard, source, block and the number of its words that are taken."""
    quota = np.array([q.slots for q in found])
    blocks = np.array([q.blocks for q in found])
    size = np.array([q.size for q in found])
    last = np.array([q.last for q in found])
    beyond = np.cumsum(np.maximum(drawn - quota, 0)) - np.maximum(drawn - quota, 0)
    lacking = np.cumsum(np.maximum(quota - drawn, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, n, first, end = (c.to_numpy() for c in batch.columns)
            run_of = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(run_of)) - np.repeat(np.cumsum(n) - n, n)
            src, rank = source[run_of], (end - n)[run_of] + within
            over = rank >= quota[src]
            number = beyond[src[over]] + rank[over] - quota[src[over]]
            to = np.searchsorted(lacking, number, side="right")
            src[over], rank[over] = to, quota[to] - lacking[to] + number
            per = np.maximum(blocks[src], 1)
            turn, place = np.divmod(rank, per)
            block = permute(place, per, pass_key(src, turn))
            words = np.minimum(BLOCK, size[src] - block * BLOCK)
            words = np.where(rank == quota[src] - 1, last[src], words)
            # slots of a source stand side by side as drawn; another permutation spreads them over the shard
            room = np.minimum(SHARD_SLOTS, slots - shard * SHARD_SLOTS)
            slot = permute(first[run_of] + within, room[run_of], shard[run_of] + (SEED << 20))
            cols = [shard[run_of], slot, src, block, turn, words]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["shard", "slot", "source_no", "block", "turn", "words"])

    return run


def schedule(spark: SparkSession, found: list[Quota]) -> DataFrame:
    """All slots of the mix: ``shard``, ``slot`` in it, ``source_no``, ``block``, ``turn`` (pass) and ``words``."""
    slots = sum(q.slots for q in found)
    schema = "shard bigint, slot bigint, source_no bigint, block bigint, turn bigint, words bigint"
    if not slots:
        return spark.createDataFrame([], schema)
    shares = np.array([q.slots for q in found]) / slots
    shards = spark.range(-(-slots // SHARD_SLOTS)).select(F.col("id").alias("shard"))
    draws = staged(shards.mapInArrow(_draws(shares, slots), "shard bigint, source bigint, n bigint, first bigint"), "draws")
    drawn = np.zeros(len(found), np.int64)
    for r in draws.groupBy("source").agg(F.sum("n").alias("n")).collect():  # a row for each source
        drawn[r.source] = r.n
    bucketed = draws.withColumn("_bucket", F.floor(F.col("shard") / SHARD_BUCKET))
    numbered = running_sums(bucketed, ["source"], "_bucket", [F.col("shard")], {"end": F.col("n")})
    return numbered.select("shard", "source", "n", "first", "end").mapInArrow(_slot_batches(found, drawn, slots), schema)


def sources(rows: DataFrame) -> tuple[DataFrame, list[Quota]]:
    """One row per source: ``source``, ``n`` documents, ``source_no`` in order, ``source_size`` in words, ``target``; and
    the quotas in that order."""
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    order = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))  # str compares by code points
    found = quotas([r["size"] for r in order])
    made = [(r["source"], r["n"], i, q.size, q.target) for i, (r, q) in enumerate(zip(order, found, strict=True))]
    kind = rows.schema["source"].dataType.simpleString()
    return rows.sparkSession.createDataFrame(made, f"source {kind}, n bigint, source_no bigint, source_size bigint, target double"), found


def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with its source's numbers and ``start``, the words before it in its source's stream."""
    folded = rows.groupBy("source", "doc_id", "key", "size").agg(F.count(F.lit(1)).alias("_c"))
    known = counted_join(folded, found, ["source"], "inner", F.col("key"))
    # very many equal rows: parts of them go to buckets of their own
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    parts = known.withColumn("_part", F.explode(F.sequence(zero, F.floor((F.col("_c") - 1) / COPIES), one)))
    parts = parts.withColumn("_c", F.least(F.lit(COPIES), F.col("_c") - F.col("_part") * COPIES))
    bucketed = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "key", "_part", F.lit(SEED)), F.lit(BUCKETS)))
    order = [F.col(c) for c in ("doc_id", "key", "size", "_part")]
    ended = running_sums(bucketed, ["source_no"], "_bucket", order, {"_end": F.col("_c") * F.col("size")})
    copies = ended.withColumn("_k", F.explode(F.sequence(zero, F.col("_c") - 1, one)))
    begin = F.col("_end") - (F.col("_c") - F.col("_k")) * F.col("size")
    return copies.select("source_no", "doc_id", "size", "source_size", "target", begin.alias("start"))


def block_pieces(rows: DataFrame) -> DataFrame:
    """The pieces of documents that each block consists of: ``begin`` and ``length`` in the block, ``from_word`` in the text."""
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last, F.lit(1).cast("bigint"))))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return cut.select("source_no", "doc_id", "start", "block", (low - F.col("block") * BLOCK).alias("begin"), (high - low).alias("length"), (low - F.col("start")).alias("from_word"))


@dataclass(frozen=True)
class Mix:
    """The mix of a corpus: its ``rows`` with their places, its ``sources``, and its ``slots``."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame

    def pieces(self) -> DataFrame:
        """The mixed stream: shard, slot, place in the slot, and the words of a document that stand there."""
        joined = block_pieces(self.rows).join(self.slots, ["source_no", "block"]).where("begin < words")
        return joined.withColumn("length", F.least(F.col("length"), F.col("words") - F.col("begin"))).drop("words")

    def taken(self) -> DataFrame:
        """Words that the mix takes of every document, repeats counted."""
        sums = self.pieces().groupBy("source_no", "start").agg(F.sum("length").alias("taken"))
        none = self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
        some = self.rows.where("size > 0").join(sums, ["source_no", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        return some.unionByName(none)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    spark = docs.sparkSession
    narrow = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(count_words(narrow), "word-counts")
    found, quota = sources(rows)
    return Mix(staged(placed(rows, found), "places"), found, staged(schedule(spark, quota), "slots"))


@query("op12_source_mix")
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")
