"""Best paths through lattices of phrases, and learned sentence boundaries."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from topicweave.operators import lattice, sentences

TEXTS = [
    (1, "new york city hall is in new york city, new york"), (2, "city hall\nnew york city hall . york city"), (3, None), (4, ""), (5, "  "),
    (6, "the hall of new york city hall ! unknown words here"), (7, "a b c d e a b c d e"), (8, "under_score a b"),
]


def by_all_paths(tokens, weights, unknown, longest):
    """Every way to cut the words; of equal sums the one whose later phrases are longer."""
    best = None
    for marks in product((0, 1), repeat=max(len(tokens) - 1, 0)):
        sizes, k = [], 1
        for m in marks:
            if m:
                sizes.append(k)
                k = 1
            else:
                k += 1
        sizes.append(k)
        at, total = 0, 0
        for size in sizes:
            gram = " ".join(tokens[at : at + size])
            total = None if total is None or (size > 1 and gram not in weights) or size > longest else total + weights.get(gram, unknown)
            at += size
        if total is not None and (best is None or (total, sizes[::-1]) > best[:2]):
            best = (total, sizes[::-1], sizes)
    out, at = [], 0
    for size in best[2]:
        out.append("_".join(tokens[at : at + size]))
        at += size
    return " ".join(out)


@pytest.mark.parametrize("limit", [1000, 0], ids=["trie", "join"])
def test_best_path(spark, monkeypatch, limit):
    frame = spark.createDataFrame(TEXTS, "id long, text string")
    found = lattice.phrases(frame, "text", 4, 2)
    listed = {r.gram: r for r in found.collect()}
    assert listed["new york city hall"].n == 3 and listed["new york"].n == 5 and listed["new york"]["size"] == 2 and "hall of" not in listed and "city, new" not in listed
    kept = found.where("gram <> 'unknown'")
    monkeypatch.setattr(lattice, "MAX_LEXICON", limit)
    got = {r.id: r.text for r in lattice.segment_lattice(frame, "text", "id", kept).collect()}
    weights, unknown = {g: r.weight for g, r in listed.items() if g != "unknown"}, min(r.weight for r in listed.values())
    cut = {r.id: r.c for r in frame.select("id", lattice.clauses(F.col("text")).alias("c")).collect()}
    for i, parts in cut.items():
        assert got[i] == (None if parts is None else " ".join(by_all_paths(list(c), weights, unknown, 4) for c in parts if c))
    assert "new_york_city_hall" in got[6]


def test_longer_phrases_win_ties():
    assert lattice.best_path([{1: -2}, {1: -2, 2: -4}, {1: -1, 2: -3, 3: -5}], -9) == [3]
    assert lattice.best_path([], -9) == []


PROSE = ["We met Dr. Smith at noon. He said that Dr. Jones was away. The lab was shut.", "It costs approx. ten euros. The price is approx. right! Is it? Yes.", "Ask Dr. Brown. The answer is no.", "noon away shut euros smith jones no brown yes"]


def test_sentences(spark):
    rows = [(i, t) for i, t in enumerate(PROSE * 30)] + [(1000, None), (1001, ""), (1002, "no end"), (1003, "See Dr. Smith. The end.")]
    frame = spark.createDataFrame(rows, "id long, text string")
    marks = sentences.learn_marks(frame, "text")
    listed = {r.type: r for r in marks.collect()}
    assert {t for t, r in listed.items() if r.is_abbreviation} & {"dr", "approx", "noon", "away", "shut", "no", "smith"} == {"dr", "approx"}
    assert (listed["dr"].n_dot, listed["dr"].n_plain) == (91, 0) and listed["the"].n_plain == 91 and listed["the"].is_starter
    got = {r.id: r.sentences for r in sentences.split_sentences(frame, "text", "id", marks).collect()}
    assert got[1000] is None and got[1001] == [] and got[1002] == ["no end"]
    assert all(" ".join(s) == t for (i, t) in rows if t for s in [got[i]])
    assert got[1003][0].startswith("See Dr. Smith.")
    assert not any(s.endswith("Dr.") for x in got.values() if x for s in x)


def test_large_lexicon_is_joined_for_rare_phrases_only(spark, monkeypatch):
    """The heaviest phrases are looked up in the row; only runs that may be among the others are moved."""
    frame = spark.createDataFrame(TEXTS, "id long, text string")
    kept = lattice.phrases(frame, "text", 4, 2)
    whole = {r.id: r.text for r in lattice.segment_lattice(frame, "text", "id", kept).collect()}
    moved, join = [], lattice.counted_join
    monkeypatch.setattr(lattice, "counted_join", lambda runs, *a, **b: (moved.append(runs.count()), join(runs, *a, **b))[1])
    for limit in (0, 8, 16):
        monkeypatch.setattr(lattice, "MAX_LEXICON", limit)
        assert {r.id: r.text for r in lattice.segment_lattice(frame, "text", "id", kept).collect()} == whole
    assert moved[0] > moved[1] > moved[2]
