"""Words and runs of words cut, counted and looked up by numpy, against plain loops."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicweave.functions import text as tx
from topicweave.operators import grams, lattice, lexicon

PIECES = [*"ab.,!?;:…é\n\t\r\x0b\x0c\x1c\x1f  ", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "‧", "\x80", "¦", "… "]


def texts(seed=1, n=400):
    rng = random.Random(seed)
    return [None, "", " ", "\n", *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n))]


def by_clause(c):
    """The words of each text, clause by clause."""
    words, out, lo = c.words.to_pylist(), [], 0
    for hi in c.ends:
        out.append([])
        for k in range(lo, hi):
            if c.first[k]:
                out[-1].append([])
            out[-1][-1].append(words[k])
        lo = hi
    return out


@pytest.mark.parametrize("size", [200, grams.CHUNK_BYTES])
def test_cuts_and_counts_equal_the_columns(frame, monkeypatch, size):
    monkeypatch.setattr(grams, "CHUNK_BYTES", size)
    rows = texts()
    df = frame(list(enumerate(rows)), "i int, t string")
    want = df.select(lattice.clauses(F.col("t")).alias("c"), tx.words(F.col("t")).alias("w"), "i").orderBy("i").collect()
    plain = {True: [[list(x) for x in r.c or [] if x] for r in want], False: [[list(r.w)] if r.w else [] for r in want]}
    for clauses, lists in plain.items():
        assert [x for some in grams.chunks(pa.array(rows)) for x in by_clause(grams.cut(some, clauses))] == lists
        words, runs, n_pairs = grams.frequent_grams(df, "t", 3, 3, clauses)
        flat = [x for c in lists for x in c]
        counts = Counter((" ".join(x[i : i + k]), k) for x in flat for k in (1, 2, 3) for i in range(len(x) - k + 1))
        assert {r.gram: r.n for r in words.collect()} == {g: n for (g, k), n in counts.items() if k == 1}
        assert {(r.gram, r["size"]): r.n for r in runs.collect()} == {g: n for g, n in counts.items() if g[1] > 1 and n >= 3}
        assert n_pairs == sum(len(x) - 1 for x in flat)


def test_lexicon_finds_what_is_listed(monkeypatch):
    listed = {"a": -1, "a b": -2, "a b c": -3, "b c d e": -4, "x  y": -5, " z": -6, "long weight": -(1 << 40)}
    c = grams.cut(pa.array(["a b c d e x y", "z a b", "b. c d e", "long weight"]), True)
    for one_each in (True, False):
        if not one_each:  # words that share a hash are told apart by their text
            monkeypatch.setattr(grams, "word_hashes", lambda w: grams.np.zeros(len(w), grams.np.uint64))
        found = grams.Lexicon(pa.array([*listed]), grams.np.array([*listed.values()]))
        got = sorted((int(i), k, int(w)) for k, at, weight in found.spans(c) for i, w in zip(at, weight, strict=True))
        assert got == [(0, 1, -1), (0, 2, -2), (0, 3, -3), (1, 4, -4), (8, 1, -1), (8, 2, -2), (14, 2, -(1 << 40))]


def test_no_row_for_each_run(frame, monkeypatch):
    """A chunk sends a row for each group of hashes, however many words it has, and a lexicon that fits needs no join."""
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three"] * 300)], names=["text"])
    (sent,) = grams._counted_rows(iter([batch]), True)
    assert sent.num_rows == grams.PARTS and sum(len(x.as_py()) for x in sent["pairs"]) == 8
    monkeypatch.setattr(lattice, "counted_join", None)
    monkeypatch.setattr(lexicon, "counted_join", None)
    rows = frame([(i, "one two three four, five") for i in range(50)], "i int, t string")
    found = lattice.phrases(rows, "t")
    assert {r.n for r in found.collect()} == {50}
    assert {r.t for r in lattice.segment_lattice(rows, "t", "i", found).collect()} == {"one_two_three_four, five"}
    pairs = frame([("one", "two", 5), ("two", "three", 5), ("three", "four,", 5)], "w1 string, w2 string, n_pair int")
    assert {r.t for r in lexicon.segment_words(rows, "t", "i", pairs).collect()} == {"one_two three_four, five"}


def test_tone_marks_by_distinct_words(frame):
    """Each distinct word is looked at once for all texts of a chunk; a word that is no syllable keeps its bars."""
    rows = pa.array(["hoá  thuỷ\thoá", None, "", " gía a|oá|b épationre ", "plain words"])
    got = tx._toned.func(rows).to_pylist()
    assert got == ["hóa thủy hóa", None, "", "gía a|oá|b épationre", "plain words"]
    tx.place_tone.cache_clear()
    tx._toned.func(pa.array(["hoá thuỷ hoá quý của"] * 1000))
    assert tx.place_tone.cache_info().misses == 4 and tx.place_tone.cache_info().hits == 0
