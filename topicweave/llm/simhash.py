"""SimHash near-duplicates (operator 2).

A text's fingerprint has 64 bits: bit b is set if more than half of its three-word shingles (repeats included) have bit b
set in their XXH64. Fingerprints that differ in at most ``MAX_BITS`` bits are linked, and linked fingerprints form
components.

Candidates come from pigeonhole blocks. The 64 bits are cut into ``BLOCKS`` blocks; two fingerprints that differ in at
most two bits agree in all but two blocks at least, so each *distinct* fingerprint is entered once for every choice of
blocks to leave out, under the bits that stay. Fingerprints that meet under a key are compared bit by bit. A key that
holds more than ``MAX_BLOCK`` distinct fingerprints is not compared pair by pair: its entries are split further, by the
bits that were left out. There, each fingerprint is entered under its own bits and under every value one bit away; those
that meet differ from the shared value in one bit at most, hence from each other in two at most, and every two that
differ in two bits meet. No group of that kind has more than 27 members, so nothing grows with the square of a group.

Copies share a fingerprint and are folded together before anything is compared. Components are found by alternating
large-star and small-star steps, each written to the shared folder.

Null and empty texts, and texts of white space, have the fingerprint zero and are linked like any other. A text of one or
two words is one shingle. Rows with a null id get their component like others (the id is ignored for the smallest id of
the component; a component of null ids only has a null id). Repeated rows give repeated results; an empty table an empty
one. Extra columns of the input are not read.

The pipeline's stage (``keep_one``) keeps one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import drop_rows, query, table, text_key
from topicweave.operators.bounded import maybe_in, unused
from topicweave.session import staged

BITS = 64
MAX_BITS = 2
SHINGLE = 3
SEED = 42
BLOCKS = 5
MAX_BLOCK = 32
CHUNK = 1 << 15
MAX_ROUNDS = 60


def fingerprint(text: str | None) -> int:
    """SimHash of a text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and six white-space characters only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    hash64, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        part = words[lo : lo + CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter((hash64(x, SEED) for x in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1]), "fp bigint"])
    return narrow.mapInArrow(_fingerprint_batches, schema)


def block_masks() -> list[int]:
    """One mask for each choice of ``MAX_BITS`` blocks to leave out, as signed 64-bit numbers; set bits stay."""
    edge = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(BLOCKS)]
    masks = [((1 << BITS) - 1) & ~sum(block[i] for i in out) for out in combinations(range(BLOCKS), MAX_BITS)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of linked fingerprints: enough of them to connect whatever is within ``MAX_BITS`` bits."""
    masks = block_masks()
    mask_table = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    entries = distinct.select("fp", F.explode(mask_table).alias("m")).select("fp", "m.choice", "m.mask", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    sizes = staged(entries.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-sizes")
    met = staged(entries.join(sizes, ["choice", "key"]), "block-entries")
    few = met.where(F.col("n") <= MAX_BLOCK).select("choice", "key", "fp")
    a, b = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    pairs = a.join(b, ["choice", "key"]).where(close).select("a", "b")
    one_bit = F.array(*[F.lit((1 << i) - (1 << BITS if i == BITS - 1 else 0)) for i in range(BITS)])
    free = F.filter(one_bit, lambda x: x.bitwiseAND(F.col("mask")) == 0)
    near = F.concat(F.array(F.col("fp")), F.transform(free, lambda x: x.bitwiseXOR(F.col("fp"))))
    many = met.where(F.col("n") > MAX_BLOCK).select("choice", "fp", F.explode(near).alias("point"))
    stars = many.groupBy("choice", "point").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")  # at most 27
    spokes = stars.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b"))
    return pairs.union(spokes).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it is connected with.

    Large-star and small-star steps alternate until nothing changes; every step lowers the sum of all edge ends, and
    the number of rounds grows with the logarithm of the longest chain. Neighbourhoods are never collected: a step is
    one minimum per node and one join.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        ends = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            ends = ends.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            ends = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = ends.join(low, "u")
        if large:  # larger neighbours move to the smallest one
            moved = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:  # smaller neighbours and the node itself
            moved = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return moved.where("a <> b").distinct()

    edges = staged(edges, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        edges = staged(step(step(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the digest ``text_key`` of the text, ``fp``, ``root`` (smallest fingerprint) and ``component_id`` of every row."""
    rows = staged(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")), ["doc_id", "text_key"]), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = staged(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = staged(named.join(smallest, "root").select("fp", "root", "component_id"), "component-ids")
    return rows.join(by_fp, "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near duplicates: that with the smallest id (null ids last; of equal ids the smallest
    digest). Of rows that repeat an id and a text one stays; only such rows are shuffled with their texts."""
    found = staged(near_duplicates(docs).select("doc_id", "text_key", "root"), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("f")
    best = found.groupBy("root").agg(first).select("root", F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key"))
    folded = found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    known = staged(folded.join(best, "root").withColumn("best", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))), "members")
    kept = drop_rows(docs, staged(known.where("NOT best").select("doc_id", "text_key"), "near-copies"))
    (key,) = unused(docs.columns, "_tk")
    keyed = kept.withColumn(key, text_key(F.col("text")))
    repeated = staged(known.where("best AND n > 1").select(F.col("text_key").alias(key)), "repeated")
    once, more = maybe_in(keyed, repeated, key, "left_anti"), maybe_in(keyed, repeated, key)
    return once.unionByName(more.dropDuplicates(["doc_id", key])).drop(key)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
