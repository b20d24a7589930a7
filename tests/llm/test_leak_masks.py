"""No overlap that the word check accepts goes unseen for want of a seed."""

import random
from itertools import combinations
from math import ceil

import brute

from topicweave.llm import decontaminate as d


def seeded(masks, size, wrong):
    starts = ((m, s) for m in masks for s in range(size - len(m) + 1))
    return any(all(bit == "0" or s + i not in wrong for i, bit in enumerate(m)) for m, s in starts)


def test_every_pattern_of_changed_words_has_a_seed():
    for size in range(7, d.WINDOW + 1):
        for n in range(size - ceil(size * d.MIN_SIMILARITY) + 1):
            assert [w for w in combinations(range(size), n) if not seeded(d.MASKS[size], size, w)] == []


def test_changed_words_at_all_pairs_of_positions(spark):
    rng = random.Random(4)
    items, docs = [], []
    for size in range(7, 14):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        items.append((size, " ".join(words)))
        for wrong in combinations(range(size), 2 if size > 9 else 1):
            docs.append((len(docs), "before it " + " ".join("zz" if i in wrong else w for i, w in enumerate(words)) + " after it"))
    words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
    items.append((104, " ".join(words)))
    docs.append((len(docs), " ".join("zz" if i % 8 > 5 else w for i, w in enumerate(words))))
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == brute.leaks(docs, items) and len(got) == len(docs)


def test_short_items_and_scripts_without_spaces(spark):
    rng = random.Random(6)
    items = [(n, " ".join(f"k{rng.randrange(10**6)}" for _ in range(n))) for n in range(1, 7)]
    items += [(20, "人工智能改变世界的方式很多种"), (21, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (22, "le c\u0153ur \u201cbat\u201d encore")]
    docs = [(i, f"start of it, {t.upper()}! end of it") for i, t in items] + [(100 + i, t) for i, t in items]
    docs += [(200 + i, "start " + t.replace(" ", " x ", 1) + " end") for i, t in items[1:6]]
    docs += [(301, "他们说人工智能改变世界的方法很多种吧"), (302, None), (303, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (30, ""), (31, None), (32, "!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.overlaps(frame, bench).collect()}
    assert got == brute.leaks(docs, items) and {(i, i) for i, _ in items} <= got and {(100 + i, i) for i, _ in items} <= got and (301, 20) in got
    kept = {r.doc_id for r in d.drop_contaminated(frame, bench).collect()}
    # in a longer document a short item is no leak
    assert kept >= {*range(1, 7), 22, 302, 303} and not kept & {20, 21, 301, *(100 + i for i, _ in items)}
