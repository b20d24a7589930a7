"""Words and runs of words in Arrow batches: cut, counted and found by numpy, without a step for each word.

``cut`` finds the words of a batch of texts in its bytes, as ``functions.text.words`` (and, with clauses, ``lattice.clauses``)
would. Frequent runs are counted in two passes. The first counts the words, and the pairs by a hash: a task sends hashes and
counts as arrays, dealt by hash, and a reducer keeps the hashes seen often enough. A run of words can only be frequent if
all of its pairs are, so the second pass counts just the runs whose pairs are kept, by their text. Hashes that collide make
a run be counted in vain, and never wrongly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.session import staged

CHUNK_BYTES = 3 << 20  # texts looked at together; a longer text is a chunk of its own
EMIT_ROWS = 1 << 17
PIECE = 8 << 20  # bytes of a lexicon in a row
HELD_ROWS = 1 << 19  # runs that a task sums up before it sends them
PART_BITS = 9
PARTS = 1 << PART_BITS  # groups of hashes that are reduced together
GRAM_COLUMNS = ["sizes", "grams", "counts"]
MAX_BITS = 28  # of the bitmap of frequent pairs: 32 MB at most
ODD, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
TURN_2, PLACE = np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

_SPACE, _BREAK, _MARK, _LEAD = (np.zeros(256, bool) for _ in range(4))
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BREAK[[9, 10, 11, 12, 13, 32]] = True  # white space that ends a clause behind a mark
_MARK[[ord(c) for c in ".!?,;:"]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = [(0xC2, x) for x in (0x85, 0xA0)] + [(0xE1, 0x9A, 0x80), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)]
_WIDE += [(0xE2, 0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)]


@dataclass
class Cut:
    """Words of some texts: ``words`` as an array of strings, each word's place among ``listed`` distinct words as ``code``.
    ``first`` marks the first word of each clause (of each text, if clauses don't count), ``ends`` has the number of words up
    to the end of each text."""

    words: pa.Array
    first: np.ndarray
    ends: np.ndarray
    code: np.ndarray
    listed: pa.Array

    def room(self) -> np.ndarray:
        """For each word the number of words from it to the end of its clause."""
        at = np.flatnonzero(self.first)
        ends = np.append(at[1:], len(self.first))[: len(at)]
        return np.repeat(ends, ends - at) - np.arange(len(self.first))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins and ends."""
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def _strings(data: np.ndarray, ends: np.ndarray, kind=pa.string()) -> pa.Array:
    """An array of strings from their bytes, one after the other, and their ends."""
    places = np.zeros(len(ends) + 1, np.int32)
    places[1:] = ends
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, some at a time; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = _bytes(texts)[1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + CHUNK_BYTES, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def cut(texts: pa.Array, clauses: bool) -> Cut:
    data, at = _bytes(texts)
    space = _SPACE[data]
    lead = np.flatnonzero(_LEAD[data])
    for wide in _WIDE:
        here = lead[lead + len(wide) <= len(data)]
        for k, byte in enumerate(wide):
            here = here[data[here + k] == byte]
        for k in range(len(wide)):
            space[here + k] = True
    word = ~space
    edge = at[(at > 0) & (at < len(data))]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= space[:-1]
    begins[edge] = word[edge]
    stops[:-1] &= space[1:]
    stops[edge - 1] = word[edge - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(stops) + 1 - start
    words = _strings(data[word], np.cumsum(size))
    ends = np.searchsorted(start, at[1:])
    first = np.zeros(len(start) + 1, bool)
    first[0] = True
    first[ends] = True
    if clauses and len(data):
        mark = _MARK[data]
        dots = np.flatnonzero(data == 0xA6)
        dots = dots[dots > 1]
        mark[dots[(data[dots - 1] == 0x80) & (data[dots - 2] == 0xE2)]] = True
        broken = data == 10
        broken[1:] |= mark[:-1] & _BREAK[data[1:]]
        first[np.searchsorted(start, np.flatnonzero(broken))] = True
    found = words.dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Cut(words, first[:-1], ends, code, found.dictionary)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * TURN
    h = (h ^ (h >> np.uint64(27))) * TURN_2
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, none of them empty: a polynomial over its bytes, mixed."""
    data, at = _bytes(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    size = np.diff(at)
    powers = np.full(size.max(), PLACE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inside = np.arange(len(data), dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), size)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[inside], at[:-1])
    return _mixed(sums + size.astype(np.uint64))


def _pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * ODD + right)


def _blobs(columns: list[tuple[np.ndarray, np.ndarray, int]]) -> list[pa.Array]:
    """Arrays cut at places, a part of each for every group, as bytes; a number has so many bytes."""
    return [_strings(np.ascontiguousarray(x).view(np.uint8), np.asarray(ends) * width, pa.binary()) for x, ends, width in columns]


def _dealt(grams: pa.Array, counts: np.ndarray, hashes: np.ndarray) -> list[pa.Array]:
    """Sizes, bytes and counts of the grams of each group."""
    group = (hashes >> np.uint64(64 - PART_BITS)).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    data, at = _bytes(grams.take(pa.array(order)))
    ends = np.cumsum(np.bincount(group, minlength=PARTS))
    return _blobs([(np.diff(at).astype(np.int32), ends, 4), (data, at[ends], 1), (counts[order].astype(np.int64), ends, 8)])


def _counted_rows(batches: Iterator[pa.RecordBatch], clauses: bool) -> Iterator[pa.RecordBatch]:
    """For each group of hashes its words and their counts, and of its pairs the next 32 bits of the hash and the counts."""
    groups, shift = np.arange(PARTS), np.uint64(64 - PART_BITS - 32)
    for batch in batches:
        for texts in chunks(batch.column(0)):
            c = cut(texts, clauses)
            hashes = word_hashes(c.listed)
            both = ~c.first[1:]
            pairs = _pair_hashes(hashes[c.code[:-1][both]], hashes[c.code[1:][both]]) >> shift
            total = np.where(groups == 0, len(pairs), 0)
            pairs, n = np.unique(pairs, return_counts=True)
            ends = np.searchsorted(pairs, (groups + 1).astype(np.uint64) << np.uint64(32))
            seen = _blobs([(pairs.astype(np.uint32), ends, 4), (np.minimum(n, 255).astype(np.uint8), ends, 1)])
            words = _dealt(c.listed, np.bincount(c.code, minlength=len(c.listed)), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(groups.astype(np.int32)), *words, *seen, pa.array(total)], names=["part", *GRAM_COLUMNS, "pairs", "seen", "total"])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for chunk in column.chunks for x in chunk]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _summed(table: pa.Table) -> pa.Table:
    """``gram`` and ``n`` of a group."""
    grams = _strings(_joined(table["grams"], np.uint8), np.cumsum(_joined(table["sizes"], np.int32)))
    counts = pa.table({"gram": grams, "n": _joined(table["counts"], np.int64)}).group_by("gram", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"gram": counts["gram"].combine_chunks(), "n": counts["n_sum"].combine_chunks()})


def _words_and_pairs(table: pa.Table, least: int) -> pa.Table:
    """The words of a group; and in a row without a word the number of pairs, and the upper 32 bits of the frequent ones."""
    words = _summed(table)
    pairs, seen = _joined(table["pairs"], np.uint32), _joined(table["seen"], np.uint8)
    order = np.argsort(pairs)
    pairs, seen = pairs[order], seen[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    kept = pairs[new][np.add.reduceat(seen, new) >= min(least, 255)] if len(new) else pairs
    kept = np.uint32(table["part"][0].as_py() << (32 - PART_BITS)) | (kept >> np.uint32(PART_BITS))
    last = {"gram": pa.array([None], pa.string()), "n": pa.array([pc.sum(table["total"]).as_py()]), "pairs": pa.array([kept.tobytes()], pa.binary())}
    return pa.concat_tables([words.append_column("pairs", pa.nulls(len(words), pa.binary())), pa.table(last)])


def _frequent(table: pa.Table, least: int) -> pa.Table:
    found = _summed(table)
    found = found.filter(pc.greater_equal(found["n"], least))
    return pa.table({"gram": found["gram"], "size": pc.add(pc.count_substring(found["gram"], " "), 1).cast(pa.int32()), "n": found["n"]})


def _runs_in(batches: Iterator[pa.RecordBatch], clauses: bool, longest: int, shared) -> Iterator[pa.RecordBatch]:
    """Runs of two words and more, all of whose pairs may be frequent, with their counts; for each group of hashes."""
    bitmap = np.frombuffer(shared.value, np.uint8)
    held: list[pa.Table] = []

    def sent() -> pa.RecordBatch:
        found = pa.concat_tables(held).group_by("gram", use_threads=False).aggregate([("n", "sum"), ("hash", "min")])
        held.clear()
        pa.default_memory_pool().release_unused()
        blobs = _dealt(found["gram"].combine_chunks(), found["n_sum"].to_numpy(), found["hash_min"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), *blobs], names=["part", *GRAM_COLUMNS])

    for batch in batches:
        for texts in chunks(batch.column(0)):
            c = cut(texts, clauses)
            hashes = word_hashes(c.listed)[c.code]
            inner = np.flatnonzero(~c.first[1:])
            pairs = _pair_hashes(hashes[inner], hashes[inner + 1])
            on = _may_hold(bitmap, pairs)
            at, known, run = inner[on], c.code[inner[on]], pairs[on]
            linked = np.zeros(len(c.first) + longest, bool)
            linked[at] = True
            for size in range(2, longest + 1):
                if size > 2:
                    on = linked[at + size - 2]
                    at, known, run = at[on], known[on], run[on]
                    run = _pair_hashes(run, hashes[at + size - 1])
                _, place, known, n = np.unique(known * len(c.listed) + c.code[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
                some = at[place]
                grams = pc.binary_join_element_wise(*(c.listed.take(pa.array(c.code[some + k])) for k in range(size)), " ")
                held.append(pa.table({"gram": grams, "n": n, "hash": run[place]}))
            if sum(map(len, held)) > HELD_ROWS:
                yield sent()
    if held:
        yield sent()


def _may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 8).bit_length() - 1
    place = hashes >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(blobs: list[bytes]) -> bytes:
    """A bit for each hash, of which the upper 32 bits are given; about one bit in sixteen is set."""
    n = sum(len(b) for b in blobs) // 4
    bits = min(MAX_BITS, max(10, (16 * n).bit_length()))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for b in blobs:
        place = np.frombuffer(b, np.uint32) >> np.uint32(32 - bits)
        np.bitwise_or.at(out, place >> np.uint32(3), np.left_shift(1, place & np.uint32(7)).astype(np.uint8))
    return out.tobytes()


def frequent_grams(df: DataFrame, text: str, longest: int, least: int, clauses: bool) -> tuple[DataFrame, DataFrame, int]:
    """All words (``gram``, ``n``); all runs of 2 to ``longest`` neighbouring words seen ``least`` times or more (``gram``,
    ``size``, ``n``); and the number of pairs of neighbouring words. With ``clauses`` a run stays inside a clause."""
    spark, rows = df.sparkSession, df.select(F.col(text).cast("string").alias("text"))
    blobs = "sizes binary, grams binary, counts binary"
    sent = rows.mapInArrow(lambda b: _counted_rows(b, clauses), f"part int, {blobs}, pairs binary, seen binary, total bigint")
    found = staged(sent.groupBy("part").applyInArrow(lambda t: _words_and_pairs(t, least), "gram string, n bigint, pairs binary"), "words")
    sums = found.where("gram IS NULL").select("n", "pairs").collect()  # a row per group
    words, total = found.where("gram IS NOT NULL").select("gram", "n"), sum(r["n"] for r in sums)
    if longest < 2:
        return words, spark.createDataFrame([], "gram string, size int, n bigint"), total
    shared = spark.sparkContext.broadcast(_bitmap([bytes(r["pairs"]) for r in sums]))
    sent = rows.mapInArrow(lambda b: _runs_in(b, clauses, longest, shared), f"part int, {blobs}")
    return words, staged(sent.groupBy("part").applyInArrow(lambda t: _frequent(t, least), "gram string, size int, n bigint"), "runs"), total


def _slots(keys: np.ndarray) -> np.ndarray:
    """An open hash table of ``keys``, all different: places in it lead to places in ``keys``."""
    slots = np.full(1 << max(4, (2 * len(keys)).bit_length()), -1, np.int32)
    left, at = np.arange(len(keys)), _slot_of(keys, slots)
    while len(left):
        free = slots[at] < 0
        slots[at[free]] = left[free]
        open_ = slots[at] != left
        left, at = left[open_], (at[open_] + 1) & (len(slots) - 1)
    return slots


def _slot_of(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * ODD) >> np.uint64(64 - (len(slots).bit_length() - 1))).astype(np.int64)


def _found(keys: np.ndarray, slots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number among ``keys``, or -1."""
    out, left, at = np.full(len(wanted), -1), np.arange(len(wanted)), _slot_of(wanted, slots)
    while len(left):
        here = slots[at]
        some = here >= 0
        left, at, here = left[some], at[some], here[some]
        hit = keys[here] == wanted[left]
        out[left[hit]] = here[hit]
        left, at = left[~hit], (at[~hit] + 1) & (len(slots) - 1)
    return out


class Lexicon:
    """Phrases with a weight each, as a trie over numbers of words: about 30 bytes a phrase. ``levels`` has for each size from
    two the keys (beginning, next word), their hash table, and the weight of the phrase that ends there, or ``none``."""

    def __init__(self, grams: pa.Array, weights: np.ndarray) -> None:
        sizes, codes, listed = [], [], pa.array([], pa.string())
        for texts in chunks(grams):
            c = cut(texts, False)
            both = pa.concat_arrays([listed, c.listed]).unique()
            codes.append(pc.index_in(c.listed, both).to_numpy(zero_copy_only=False)[c.code])
            sizes.append(np.diff(c.ends, prepend=0))
            listed = both
        sizes, codes = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (sizes, codes))
        begin = np.cumsum(sizes) - sizes
        plain = np.zeros(len(sizes), bool)
        for k in np.unique(sizes[sizes > 0]):  # a phrase that is no run of words with single spaces can't be found
            mine = np.flatnonzero(sizes == k)
            text = pc.binary_join_element_wise(*(listed.take(pa.array(codes[begin[mine] + j])) for j in range(k)), " ")
            plain[mine] = pc.equal(text, grams.take(pa.array(mine))).to_numpy(zero_copy_only=False)
        kind = np.int32 if np.abs(weights).max(initial=0) < 1 << 31 else np.int64
        sizes, begin, weights = sizes[plain], begin[plain], weights[plain].astype(kind)
        self.none = np.iinfo(kind).min
        self.listed, self.single = listed, np.full(len(listed), self.none, kind)
        self.single[codes[begin[sizes == 1]]] = weights[sizes == 1]
        self.hashes = word_hashes(listed)
        one_each = len(np.unique(self.hashes)) == len(listed)
        self.slots = _slots(self.hashes) if one_each else None
        self.levels, node = [], codes[begin]
        for k in range(2, int(sizes.max(initial=1)) + 1):
            long = sizes >= k
            sizes, begin, weights, node = sizes[long], begin[long], weights[long], node[long]
            keys, node = np.unique(node * len(listed) + codes[begin + k - 1], return_inverse=True)
            of = np.full(len(keys), self.none, kind)
            of[node[sizes == k]] = weights[sizes == k]
            self.levels.append((keys, _slots(keys), of))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, or -1."""
        if self.slots is None:
            return pc.fill_null(pc.index_in(words, self.listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = _found(self.hashes, self.slots, word_hashes(words))
        known = np.flatnonzero(at >= 0)
        same = pc.equal(words.take(pa.array(known)), self.listed.take(pa.array(at[known]))).to_numpy(zero_copy_only=False)
        at[known[~same]] = -1
        return at

    def spans(self, c: Cut) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size the places where phrases of it begin, and their weights."""
        code = self.numbers(c.listed)[c.code]
        at = np.flatnonzero(code >= 0)
        alone = self.single[code[at]]
        yield 1, at[alone != self.none], alone[alone != self.none]
        room, node = c.room(), code[at]
        for k, (keys, slots, weights) in enumerate(self.levels, 2):
            on = room[at] >= k
            at, node = at[on], node[on]
            on = code[at + k - 1] >= 0
            at, node = at[on], node[on]
            node = _found(keys, slots, node * len(self.listed) + code[at + k - 1])
            at, node = at[node >= 0], node[node >= 0]
            ends = weights[node] != self.none
            yield k, at[ends], weights[node[ends]]


def glued(c: Cut, glue: np.ndarray) -> pa.Array:
    """The texts with single spaces between words, and an underscore before each word that ``glue`` marks."""
    data, at = _bytes(c.words)
    last = np.zeros(len(at) - 1, bool)
    filled = np.diff(c.ends, prepend=0) > 0
    last[c.ends[filled] - 1] = True
    ends = at[1:] + np.cumsum(~last)  # of each word in the new text, with what separates it from the next
    marks = ends[~last] - 1
    out, letters = np.empty(len(data) + len(marks), np.uint8), np.ones(len(data) + len(marks), bool)
    letters[marks] = False
    out[letters] = data
    pa.default_memory_pool().release_unused()
    out[marks] = np.where(glue[np.flatnonzero(~last) + 1], ord("_"), ord(" "))
    return _strings(out, np.append(0, ends)[c.ends])


def run_hashes(c: Cut, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the places where runs of it begin, and 64 bits of each run."""
    words, room = word_hashes(c.listed)[c.code], c.room()
    at, hashes = np.arange(len(words)), words
    for k in range(1, sizes.stop):
        if k > 1:
            on = room[at] >= k
            at = at[on]
            hashes = _pair_hashes(hashes[on], words[at + k - 1])
        if k in sizes:
            yield k, at, hashes


def runs_among(df: DataFrame, text: str, row_id: str, grams: DataFrame, sizes: range, clauses: bool) -> DataFrame:
    """Runs of ``sizes`` words of the texts that may be in ``grams`` (``gram``): ``row_id``, ``at`` (the run's first word
    in its text), ``size`` and ``gram``. None that is goes missing, a few others stay."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(0)):
                c = cut(texts, False)
                n, begin = np.diff(c.ends, prepend=0), c.ends - np.diff(c.ends, prepend=0)
                found = [h[(at == begin[np.searchsorted(c.ends, at, "right")]) & (n[np.searchsorted(c.ends, at, "right")] == k)] for k, at, h in run_hashes(c, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array([(np.concatenate(found) >> np.uint64(32)).astype(np.uint32).tobytes()], pa.binary())], names=["bits"])

    bits = grams.select("gram").mapInArrow(hashes, "bits binary").collect()  # four bytes a phrase
    shared = df.sparkSession.sparkContext.broadcast(_bitmap([bytes(r["bits"]) for r in bits]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            lo = 0
            for texts in chunks(batch.column(1)):
                c = cut(texts, clauses)
                begin = c.ends - np.diff(c.ends, prepend=0)
                for k, at, hashes in run_hashes(c, sizes):
                    at = at[_may_hold(bitmap, hashes)]
                    for i in range(0, len(at), EMIT_ROWS):
                        some = at[i : i + EMIT_ROWS]
                        row = np.searchsorted(c.ends, some, "right")
                        gram = pc.binary_join_element_wise(*(c.words.take(pa.array(some + j)) for j in range(k)), " ")
                        place, size = (some - begin[row]).astype(np.int32), np.full(len(some), k, np.int32)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(place), pa.array(size), gram], names=["id", "at", "size", "gram"])
                lo += len(texts)

    rows = df.select(F.col(row_id).alias("id"), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, at int, size int, gram string").withColumnRenamed("id", row_id)


def _fits(lexicon: DataFrame, limit: int, max_bytes: int = 96 << 20) -> bool:
    rows, size = lexicon.agg(F.count(F.lit(1)), F.sum(F.octet_length("gram"))).first()
    return rows <= limit and (size or 0) <= max_bytes


def listed_and_rest(lexicon: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Phrases that fit a broadcast, and the others, if there are any: those of the least weight."""
    if _fits(lexicon, limit):
        return lexicon, None
    entries = lexicon.count()
    # one part in ten below the limit, because the cut is approximate
    least = lexicon.agg(F.percentile_approx("weight", 1 - min(1.0, 0.9 * limit / entries), 10_000)).first()[0]
    hot = lexicon.where(F.col("weight") > least)
    return (hot, lexicon.where(F.col("weight") <= least)) if _fits(hot, limit) else (None, lexicon)


class _Packed:
    """The pickled fields of a lexicon in pieces, which is the lexicon itself where it is unpickled."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces

    def __reduce__(self):
        return _unpacked, tuple(self.pieces)


def _unpacked(*pieces: bytes) -> Lexicon:
    out = Lexicon.__new__(Lexicon)
    vars(out).update(pickle.loads(b"".join(pieces)))
    return out


def shared_lexicon(spark, lexicon: DataFrame | None):
    """A lexicon (``gram``, ``weight``), or None, as a broadcast. A task builds it, so that the driver holds its bytes only."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = zip(*((b.column(0).cast(pa.string()), b.column(1)) for b in batches), strict=True)
        listed, weights = [pa.concat_arrays(x) for x in columns] or [pa.array([], pa.string()), pa.array([], pa.int64())]
        whole = pickle.dumps(vars(Lexicon(listed, weights.to_numpy())), pickle.HIGHEST_PROTOCOL)
        for lo in range(0, len(whole), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([whole[lo : lo + PIECE]], pa.binary())], names=["at", "piece"])

    if lexicon is None:
        return spark.sparkContext.broadcast(None)
    rows = lexicon.select("gram", F.col("weight").cast("bigint")).repartition(1).mapInArrow(build, "at bigint, piece binary").collect()
    pieces = [bytes(r["piece"]) for r in sorted(rows, key=lambda r: r["at"])]
    return spark.sparkContext.broadcast(_Packed(pieces) if pieces else None)
