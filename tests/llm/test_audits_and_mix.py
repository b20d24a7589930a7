"""Operators 11 to 13 on small tables with nulls, ties, repeats, long terms and clashing column names."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import brute
import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from topicweave.llm import divergence, filter_audit, source_mix

TERMS = ["alpha", "Beta", "été", "ÉTÉ", "x" * 40, "x" * 33 + "y", "x" * 9, "a", "ab", "abcd", "abcde", "λόγος", "snow雪", "it's", "42", "n0"]
CLASHES = ["term", "n", "docs", "key", "value", "mask", "bits", "digest", "part", "first", "size", "start", "target", "_bucket", "_c"]


def tables(folder, rows, labels=()):
    cols = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])}
    cols |= {c: pa.array(["z"] * len(rows), pa.string()) for c in CLASHES}
    pq.write_table(pa.table(cols), f"{folder}/documents.parquet")
    marks = zip(("doc_id", "quality", "toxic"), (pa.int64(), pa.int32(), pa.int32()))
    pq.write_table(pa.table({c: pa.array([r[i] for r in labels], t) for i, (c, t) in enumerate(marks)}), f"{folder}/labels.parquet")
    return str(folder)


def some_rows(n=150, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", ", "]).join(rng.choices(TERMS, k=rng.choice([0, 1, 3, 30, 250])))
        rows.append((i if i % 9 else None, rng.choice([text, text, text, None, "alpha Beta"]), rng.choice(["en", "fr", None, ""]), rng.choice(["s", "t", "é", None, "u"])))
    rows += [rows[3]] * 4 + [(3, "other text", "en", "s"), (500, "once", "xx", "only"), (501, "", "yy", "a"), (502, None, "yy", "b")]
    return rows


LABELS = [(i, i % 2, i % 3 // 2) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (6, None, None), (None, 1, 1)]


@pytest.mark.parametrize(("run", "sql"), [(divergence.op11_divergence, divergence.SQL), (filter_audit.op13_filter_audit, filter_audit.SQL)])
@pytest.mark.parametrize("rows", [some_rows(), []], ids=["some", "none"])
def test_same_rows_as_sql(spark, tmp_path, run, sql, rows):
    folder = tables(tmp_path, rows, LABELS)
    assert oracle.compare(run(spark, folder), oracle.connect(folder), sql) == []


def test_small_folds_buckets_and_blocks(spark, tmp_path, monkeypatch):
    for name, value in {"MAX_ENTRIES": 20, "BLOCK": 2, "BUCKET_ENTRIES": 3, "CELLS": 8, "FIRST_LEVEL": 1}.items():
        monkeypatch.setattr(divergence, name, value)
    folder = tables(tmp_path, some_rows(), LABELS)
    assert oracle.compare(divergence.op11_divergence(spark, folder), oracle.connect(folder), divergence.SQL) == []


def test_refinement_counts_distinct_documents(spark):
    """A prefix or term that one document repeats, or has in several forms, counts once."""
    docs = [("en", "s", "prefixaa prefixab prefixac rare rare rare"), ("en", "t", "prefixaa prefixaa"), ("en", "s", "prefixaa other"), ("fr", "s", "prefixaa rare")]
    folded = divergence.folded_terms(spark.createDataFrame(docs, "lang string, source string, text string"))
    assert {(r.lang, bytes(r.term)) for r in divergence.refine(folded).collect()} == {("en", b"prefixaa")}


def test_path_counts():
    """Orders over each edge, against all orders."""
    n = len(filter_audit.FILTERS)
    want = Counter((sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n))
    assert {(s, i): c for s, i, c in filter_audit.edges(n)} == dict(want)


def test_audit_by_plain_loops(spark):
    rows = [r for r in some_rows(60, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    smallest = {}
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    good, toxic = ({d for d, *m in LABELS if d is not None and m[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for d, t, _, s in rows:
        w, text = brute.WORD.findall(t or ""), t or ""
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > smallest[text],
        }
        parts[s or ""].append((d, {f for f in fails if fails[f]}))
    want, removed_by = {}, Counter()
    for part, listed in parts.items():
        for order in permutations("ABCDE"):
            alive = listed
            for k, f in enumerate(order):
                gone, left = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                again = sum(f in x[1] for x in listed) - len(gone)
                removed_by[part, f] += len(gone)
                want[part, "".join(order), k + 1] = (len(left), len(gone), again, sum(x[1] == {f} for x in listed), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
                alive = left
    assert {k: v[:-1] for k, v in got.items()} == want
    assert all(v[-1] == removed_by[k[0], k[1][k[2] - 1]] for k, v in got.items())


def test_permutations_and_their_inverse():
    for n in (1, 2, 3, 4, 5, 17, 64, 1000):
        for key in (0, 7, 1 << 40):
            there = source_mix.permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(there) == [*range(n)]
            assert (source_mix.permute(there, np.full(n, n), np.full(n, key), back=True) == np.arange(n)).all()


def test_shares():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.choice([0, 1, rng.randrange(50), rng.randrange(10**6)]) for _ in range(rng.randrange(1, 9))]
        found = [Fraction(a, b) if b else Fraction(0) for a, b in source_mix.share_words(sizes)]
        assert sum(found) == Fraction(3 * sum(sizes), 2) and all(t <= 2 * n for t, n in zip(found, sizes))
        weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        level = {t / w for t, w, n in zip(found, weight, sizes) if t < 2 * n}
        assert len(level) <= 1 and all(w * max(level, default=0) >= t for t, w in zip(found, weight))


@pytest.mark.parametrize(("block", "shard"), [(128, 4096), (4, 8), (1, 5)])
def test_mix_takes_what_its_slots_say(spark, monkeypatch, block, shard):
    monkeypatch.setattr(source_mix, "BLOCK", block)
    monkeypatch.setattr(source_mix, "SHARD_SLOTS", shard)
    monkeypatch.setattr(source_mix, "COPIES", 3)
    rng = random.Random(3)
    rows = [(i if i % 7 else None, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 1, 5, 60]))), rng.choice("aaab\u00e9") if i % 5 else None) for i in range(120)]
    rows += [(None, "same words here", "a")] * 20 + [(3, None, "z"), (4, "\t\n", "z"), (5, "one", "only")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, start string")
    monkeypatch.setattr(source_mix, "quotas", lambda sizes, f=source_mix.quotas: f(sizes, block))
    mixed = source_mix.mix(frame)
    got = mixed.taken().collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(brute.WORD.findall(t or ""))) for d, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sums = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        s = sums[r.source_no]
        s[0], s[1], s[2] = s[0] + r.taken, s[1] + r.size, r.target
    assert all(taken == int(target + 1e-6) and target <= 2 * size for taken, size, target in sums.values())
    assert sum(s[2] for s in sums.values()) == pytest.approx(1.5 * sum(s[1] for s in sums.values()))
    slots = mixed.slots.collect()
    assert len({(s.shard, s.slot) for s in slots}) == len(slots) and all(0 <= s.slot < shard for s in slots)
    assert max(Counter((s.source_no, s.block) for s in slots).values()) <= 2
    # every word that a slot holds, from the streams themselves
    stream = defaultdict(dict)
    for r in mixed.rows.collect():
        for k in range(r.size):
            stream[r.source_no][r.start + k] = (r.source_no, r.start)
    assert all(sorted(x) == [*range(len(x))] for x in stream.values())
    words = Counter(stream[s.source_no][s.block * block + k] for s in slots for k in range(s.words))
    assert all(words[r.source_no, r.start] == r.taken for r in got if r.size)
    again = source_mix.mix(frame.repartition(5, "text")).taken().collect()
    assert Counter((r.doc_id, r.size, r.target, r.taken) for r in again) == Counter((r.doc_id, r.size, r.target, r.taken) for r in got)
    assert source_mix.mix(frame.limit(0)).taken().count() == 0


def test_a_fold_counts_short_and_long_terms():
    rng = random.Random(4)
    words = ["".join(rng.choices("aAbé", k=n)) for n in (1, 3, 4, 5, 8, 9, 16, 17, 22, 23, 24, 25, 33, 70) for _ in range(4)]
    words += [w[:20] + "zz" for w in words[-8:]] + ["", ".", "x" * 40, "x" * 30]
    docs = [(rng.choice(["en", ""]), rng.choice(["s", "t"]), rng.choice([" ", "\n", "1,"]).join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(300)]
    names = ["lang", "source", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs, strict=True)], names)
    got = pa.Table.from_batches([*divergence._fold_batches(iter([batch]))]).to_pylist()
    want = {}
    for lang, source, text in docs:
        found = text.encode().translate(divergence.TO_TERMS).split()
        for w in set(found):
            row = want.setdefault((lang, source, w), [0, 0])
            row[:] = row[0] + found.count(w), row[1] + 1
        for level in (4, 8, 16, 32, 64):
            for w in {w[:level] for w in found if len(w) > level}:
                row = want.setdefault((lang, None, w), [None, 0])
                row[1] += 1
    assert {(r["lang"], r["source"], r["term"]): [r["n"], r["docs"]] for r in got} == want and len(got) == len(want)


def test_kept_counts_move_once(spark):
    rows = [("en", s, w.encode(), 1, d) for s in "st" for w, d in (("many", 2), ("few", 1))] + [("en", None, b"many", None, 4)]
    folded = spark.createDataFrame(rows, "lang string, source string, term binary, n bigint, docs bigint")
    kept = spark.createDataFrame([("en", b"many")], "lang string, term binary")
    got = divergence.kept_counts(folded, kept)
    assert sorted(map(tuple, got.collect())) == [("en", s, b"many", 1, 2) for s in "st"]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(lang#") == 1 and plan.count("HashJoin") == 1 and "SortMergeJoin" not in plan  # the bitmap
