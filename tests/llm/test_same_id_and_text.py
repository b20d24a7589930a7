"""Rows with one id and one text, kept under one source and rejected under another."""

import random

from topicweave.llm import quality_rules


def test_each_row_gets_its_own_verdict(spark):
    rng = random.Random(2)
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(quality_rules.MIN_GROUP + 5)]
    odd = plain[0] + " ###" * 30
    rows = [(i, t, "en", "clean") for i, t in enumerate(plain)] + [(i, t + " ###" * 30, "en", None) for i, t in enumerate(plain)]
    rows += [(None, odd, "en", "clean"), (None, odd, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = quality_rules.judge(docs, keep=["doc_id", "source"]).where("doc_id IS NULL").collect()
    assert {r.source: r.kept for r in judged} == {"clean": False, None: True}
    left = quality_rules.keep_good(docs).where("doc_id IS NULL").collect()
    assert [r.source for r in left] == [None]
