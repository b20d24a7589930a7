"""Exact substring dedup with suffix arrays (operator 8).

Every byte is removed that lies in a string of ``LENGTH`` bytes which also starts anywhere else in the corpus. Matches
never cross documents; all is judged on the input.

1. *Shards.* Every window of ``LENGTH`` bytes is assigned to its anchor: the smallest hash of a ``GRAM``-byte string in the
   window. Equal windows have equal anchors, so windows that could be equal meet under one anchor value, and a text is cut
   into runs of windows with one anchor (about 185 windows, stretched over what repeats periodically). Equal runs are
   folded to one with a count, on the map side first. A run whose anchor occurs nowhere else has no repeated window and is
   dropped; its text never moves. The other runs (*contexts*) are dealt by anchor over shards of about ``SHARD_BYTES``. An
   anchor with more contexts than that is spread over several shards.
2. *Suffix arrays.* Each shard sorts its suffixes by Larsson-Sadakane refinement in numpy: by 8 bytes, then by doubled
   prefixes, each time only inside groups that are still open, up to ``LENGTH`` bytes.
3. *Common prefixes.* Kasai's rule gives the common prefix of neighbours in text order, one comparison of a stretch for all
   suffixes that share a distance. A common prefix of ``LENGTH`` or a context that stands for several runs is a repeat.
4. *Merging.* Shards that share an anchor emit the sorted digests of their distinct windows, cut by digest into ranges;
   in each range a binary search of every shard's list in the others' finds windows that repeat across shards.
5. Repeated windows go back to all runs with that context, and to the texts.

Null and empty texts, and texts under ``LENGTH`` bytes, keep all their bytes. Copies of a text, be it with equal or null
ids, are repeats of each other. Rows are named by (doc_id, text digest), null-safe. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import query, table, text_key
from topicweave.operators.bounded import maybe_in
from topicweave.session import staged

LENGTH = 400
GRAM = 32
SHARD_BYTES = 1 << 21
SLICE = 1 << 18
MAX_RUN = 1 << 14
PLACE_BITS = 20
MERGE_WINDOWS = 1 << 18

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _double(h: np.ndarray, size: int, turn: int) -> np.ndarray:
    """Hashes of strings of twice the length."""
    with np.errstate(over="ignore"):
        x = h[:-size] * ODD[turn % 5] + h[size:]
        x ^= x >> np.uint64(32)
        return x * ODD[(turn + 1) % 5]


def string_hashes(data: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes at every place; ``length`` at least 2."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1 + salt)) * ODD[salt % 5]
    size, turn = 1, salt
    while size * 2 <= length:
        h = _double(h, size, turn)
        size, turn = size * 2, turn + 1
    if size < length:  # two overlapping halves cover the rest
        h = _double(h, length - size, turn)
    return h ^ (h >> np.uint64(29))


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: anchor hash, first and last start, number of anchor places."""
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 4
    low = np.uint64((1 << PLACE_BITS) - 1)
    width = LENGTH - GRAM + 1
    value, first, last, places = [], [], [], []
    for lo in range(0, windows, SLICE):
        hi = min(windows, lo + SLICE)
        h = string_hashes(data[lo : hi + LENGTH - 1], GRAM)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes wins
        size = 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])[: hi - lo]
        at = (m & low).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        v = h[at[begin]].view(np.int64)
        # neighbouring anchors with one value (something repeats periodically) make one run
        new = np.r_[True, v[1:] != v[:-1]] | (begin % MAX_RUN < np.r_[0, begin[:-1] % MAX_RUN])
        heads = np.flatnonzero(new)
        value.append(v[heads])
        first.append(begin[heads] + lo)
        last.append(np.r_[begin[heads[1:]], hi - lo] - 1 + lo)
        places.append(np.diff(np.r_[heads, len(begin)]))
    return tuple(np.concatenate(x).astype(np.int64) for x in (value, first, last, places))


def _utf8(x) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tk", "v", "ck", "p0", "p1", "n"]
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        at: list[np.ndarray] = []

        def flush(batch=batch):
            rows = np.concatenate(at) if at else np.zeros(0, np.int64)
            made = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols]
            return pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(rows)) for i in (0, 1)], *made], names)

        for i, x in enumerate(batch.column(2)):
            raw = _utf8(x)
            v, p0, p1, n = runs(np.frombuffer(raw, np.uint8))
            view = memoryview(raw)
            ck = np.fromiter((xxhash.xxh64_intdigest(view[a : b + LENGTH]) for a, b in zip(p0.tolist(), p1.tolist(), strict=True)), np.uint64, len(v))
            for c, new in zip(cols, (v, ck.view(np.int64), p0, p1, n), strict=True):
                c.append(new)
            at.append(np.full(len(v), i))
            if sum(map(len, at[-64:])) > 1 << 16:
                yield flush()
                cols, at = [[] for _ in range(5)], []
        if at:
            yield flush()


def suffix_array(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``text`` sorted by their next ``length`` bytes, and the number of each place's group of equal ones.

    Larsson-Sadakane: sort by 8 bytes; a group number is the place of its first member in the order, so groups that are
    settled keep theirs; then refine open groups by the group number a prefix length ahead. Equal suffixes stay in text
    order. Bytes behind the end count as lower than any.
    """
    n = len(text)
    padded = np.r_[text.astype(np.uint64), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    group = np.zeros(n + length, np.int64) - 1
    open_at, sorted_key = np.arange(n), key[order]
    have = 8
    while True:
        # number the groups of the open part by the place of their first member
        head = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        number = open_at[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
        group[order[open_at]] = number
        alone = head & np.r_[head[1:], True]
        open_at = open_at[~alone]
        if have >= length or not len(open_at):
            return order, group[:n]
        ahead = min(have, length - have)
        have += ahead
        members = order[open_at]
        pair = group[members] * (n + 1) + group[members + ahead] + 1
        by = np.argsort(pair, kind="stable")
        order[open_at] = members[by]
        sorted_key = pair[by]


def common_prefixes(text: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Common prefix, up to LENGTH, of the suffix at each ``place`` (ascending) and the one at ``before``.

    Kasai's rule in text order: while the distance stays the same, the next common prefix is one shorter until a
    mismatch is passed, so one comparison of the stretch serves all of its places.
    """
    out = np.zeros(len(place), np.int64)
    if not len(place):
        return out
    apart = place - before
    heads = np.flatnonzero(np.r_[True, (np.diff(apart) != 0) | (np.diff(place) != 1)])
    for lo, hi in zip(heads, np.r_[heads[1:], len(place)].astype(np.int64), strict=True):
        a, b = place[lo], before[lo]
        reach = min(hi - lo - 1 + LENGTH, len(text) - max(a, b))
        wrong = np.flatnonzero(text[a : a + reach] != text[b : b + reach])
        ends = np.r_[wrong, reach]
        steps = np.arange(hi - lo)
        out[lo:hi] = np.minimum(ends[np.searchsorted(ends, steps)] - steps, LENGTH)
    return out


def shard_repeats(contexts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a shard's contexts: context number, start in it, is it a repeat, and is it the first of its kind."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(text)) - base[own]
    valid = start <= sizes[own] - LENGTH
    order, group = suffix_array(text)
    order = order[valid[order]]
    same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1  # neighbours in one group
    later, earlier = order[same], order[same - 1]
    by = np.argsort(later, kind="stable")
    later, earlier = later[by], earlier[by]
    full = common_prefixes(text, later, earlier) >= LENGTH
    repeat = np.zeros(len(text), bool)
    repeat[later[full]] = repeat[earlier[full]] = True
    first = np.ones(len(text), bool)
    first[later[full]] = False
    repeat |= counts[own] > 1
    at = np.flatnonzero(valid)
    return own[at], start[at], repeat[at], first[at]


def _ranges(own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring window starts: context number, first, last."""
    head = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(start) != 1)]) if len(own) else np.zeros(0, np.int64)
    tail = np.r_[head[1:] - 1, len(own) - 1].astype(np.int64) if len(own) else head
    return own[head], start[head], start[tail]


FOUND_SCHEMA = "v long, ck long, s long, e long, part int, shard long, hi binary, lo binary, own binary, start binary, fresh binary"


def _solve_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeats inside one shard; for anchors spread over shards also the sorted window digests, cut into parts."""
    contexts, counts = [*pdf["ctx"]], pdf["w"].to_numpy()
    own, start, repeat, first = shard_repeats(contexts, counts)
    v, ck = pdf["v"].to_numpy(), pdf["ck"].to_numpy()
    o, s, e = _ranges(own[repeat], start[repeat])
    out = [pd.DataFrame({"v": v[o], "ck": ck[o], "s": s, "e": e})]
    spread = pdf["subs"].to_numpy() > 1
    if spread.any():
        sizes = np.array([len(c) for c in contexts], np.int64)
        text = np.frombuffer(b"".join(contexts), np.uint8)
        at = (np.cumsum(sizes) - sizes)[own] + start
        digest = [string_hashes(text, LENGTH, salt)[at] for salt in (1, 2)]
        for value in np.unique(v[spread]):
            mine = np.flatnonzero((v[own] == value) & first)
            parts = int(pdf["subs"][v == value].iloc[0]) * 4
            part = (digest[0][mine] % np.uint64(parts)).astype(int)
            for p in np.unique(part):
                m = mine[part == p]
                m = m[np.lexsort((digest[1][m], digest[0][m]))]
                out.append(pd.DataFrame({
                    "v": [value], "ck": [0], "s": [0], "e": [0], "part": [p], "shard": [pdf["shard"].iloc[0]],
                    "hi": [digest[0][m].tobytes()], "lo": [digest[1][m].tobytes()], "own": [ck[own[m]].tobytes()],
                    "start": [start[m].tobytes()], "fresh": [(~repeat[m]).tobytes()],
                }))
    got = pd.concat(out, ignore_index=True)
    for c in ("part", "shard", "hi", "lo", "own", "start", "fresh"):
        if c not in got:
            got[c] = None
    got["part"] = got["part"].astype("Int32")
    got["shard"] = got["shard"].astype("Int64")
    return got


def _merge_shards(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of one anchor and digest range that several shards have: a binary search of each list in the others'."""
    read = lambda c, kind: [np.frombuffer(x, kind) for x in pdf[c]]
    hi, lo, own, start, fresh = read("hi", np.uint64), read("lo", np.uint64), read("own", np.int64), read("start", np.int64), read("fresh", bool)
    size = [len(x) for x in hi]
    seen = [np.zeros(n, bool) for n in size]
    # merge in order of size; a list is searched in the union of those before it
    union, where = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    for i in np.argsort(size):
        if len(union):
            left, right = np.searchsorted(union, hi[i], "left"), np.searchsorted(union, hi[i], "right")
            for k in np.flatnonzero(right > left):
                for j, q in where[left[k] : right[k]]:
                    if lo[j][q] == lo[i][k]:
                        seen[i][k] = seen[j][q] = True
        fresh_entries = ~seen[i]
        both = np.concatenate([union, hi[i][fresh_entries]])
        places = np.concatenate([where, np.stack([np.full(fresh_entries.sum(), i), np.flatnonzero(fresh_entries)], 1)])
        by = np.argsort(both, kind="stable")
        union, where = both[by], places[by]
    ck, at = [], []
    for i in range(len(size)):
        m = seen[i] & fresh[i]
        ck.append(own[i][m])
        at.append(start[i][m])
    ck, at = np.concatenate(ck), np.concatenate(at)
    by = np.lexsort((at, ck))
    o, s, e = _ranges(ck[by], at[by])
    return pd.DataFrame({"v": np.full(len(o), pdf["v"].iloc[0]), "ck": o, "s": s, "e": e})


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, from, to): byte ranges covered by repeated windows. ``docs``: doc_id, tk, text."""
    found = staged(docs.select("doc_id", "tk", "text").mapInArrow(_run_batches, "doc_id {}, tk long, v long, ck long, p0 long, p1 long, n long".format(docs.schema["doc_id"].dataType.simpleString())), "runs")
    rep = F.min(F.struct("doc_id", "tk", "p0", "p1")).alias("rep")
    folded = found.groupBy("v", "ck").agg(F.count(F.lit(1)).alias("w"), F.sum("n").alias("n"), rep)
    folded = staged(folded, "folded-runs")
    size = F.col("rep.p1") - F.col("rep.p0") + LENGTH
    per_anchor = folded.groupBy("v").agg(F.sum("n").alias("total"), F.sum(size).alias("bytes")).where("total > 1")
    per_anchor = staged(per_anchor.withColumn("subs", F.ceil(F.col("bytes") / SHARD_BYTES)), "repeated-anchors")
    total = per_anchor.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    plain = F.pmod(F.xxhash64("v"), F.lit(shards))
    own = -1 - F.pmod(F.xxhash64("v", F.pmod("ck", "subs")), F.lit(1 << 40))
    wanted = folded.join(per_anchor, "v").select("v", "ck", "w", "subs", "rep", F.when(F.col("subs") > 1, own).otherwise(plain).alias("shard"))
    by_doc = wanted.groupBy("rep.doc_id", "rep.tk").agg(F.collect_list(F.struct("v", "ck", "w", "subs", "shard", "rep.p0", "rep.p1")).alias("c"))
    by_doc = staged(by_doc.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "c"), "contexts-by-text")
    may = maybe_in(docs, by_doc.select(F.col("_tk").alias("tk")), "tk")
    texts = may.join(by_doc, may["doc_id"].eqNullSafe(by_doc["_id"]) & (may["tk"] == by_doc["_tk"])).select("text", "c")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "ck", "w", "subs", "shard"]
        for batch in batches:
            for text, listed in zip(batch.column(0), batch.column(1), strict=True):
                raw, rows = _utf8(text), listed.as_py()
                cols = [pa.array([r[c] for r in rows], pa.int64()) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([raw[r["p0"] : r["p1"] + LENGTH] for r in rows], pa.binary())], [*names, "ctx"])

    contexts = texts.mapInArrow(cut, "v long, ck long, w long, subs long, shard long, ctx binary")
    solved = staged(contexts.groupBy("shard").applyInPandas(_solve_shard, FOUND_SCHEMA), "shard-repeats")
    inside = solved.where("part IS NULL").select("v", "ck", "s", "e")
    across = solved.where("part IS NOT NULL").groupBy("v", "part").applyInPandas(_merge_shards, "v long, ck long, s long, e long")
    ranges = inside.union(across).groupBy("v", "ck").agg(F.collect_list(F.struct("s", "e")).alias("r"))  # bounded by a run
    return found.select("doc_id", "tk", "v", "ck", "p0").join(ranges, ["v", "ck"]).select(
        "doc_id", "tk", F.explode("r").alias("r"), "p0"
    ).select("doc_id", "tk", (F.col("p0") + F.col("r.s")).alias("from"), (F.col("p0") + F.col("r.e") + LENGTH).alias("to"))


def _keep_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept_texts = [], []
            for text, listed in zip(batch.column(1), batch.column(2), strict=True):
                raw = _utf8(text)
                ends = np.zeros(len(raw) + 1, np.int64)
                for r in listed.as_py() or ():
                    ends[r["from"]] += 1
                    ends[r["to"]] -= 1
                removed = np.cumsum(ends[:-1]) > 0
                spans = int(np.count_nonzero(removed & ~np.r_[False, removed[:-1]])) if len(raw) else 0
                rest = np.frombuffer(raw, np.uint8)[~removed].tobytes()
                rows.append((len(raw), int(removed.sum()), spans, hashlib.sha256(rest).hexdigest()))
                kept_texts.append(rest if with_text else None)
            cols = [*zip(*rows)] if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], pa.array(kept_texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the remaining bytes, or null) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("tk"), F.col(text).alias("text"))
    hit = repeated_runs(rows).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("from", "to")).alias("r"))  # bounded by the text
    hit = staged(hit.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "r"), "removed-ranges")
    # a bitmap of fixed size keeps the texts without repeats out of the shuffle
    keys = hit.select(F.col("_tk").alias("tk"))
    may, sure = maybe_in(rows, keys, "tk"), maybe_in(rows, keys, "tk", "left_anti")
    both = may.join(hit, may["doc_id"].eqNullSafe(hit["_id"]) & (may["tk"] == hit["_tk"]), "left").select("doc_id", "text", "r")
    both = both.union(sure.select("doc_id", "text", F.lit(None).cast(both.schema["r"].dataType)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return both.mapInArrow(_keep_batches(with_text), schema)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept").withColumn("changed", F.col("n_removed") > 0)
