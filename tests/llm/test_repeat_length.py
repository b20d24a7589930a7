"""The registered suffix dedup at the length of its contract: a shared passage is judged by its bytes, not by its words."""

import random

import brute

from topicweave.llm.suffix_dedup import op8_suffix_dedup

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_passages_by_bytes(spark, tmp_path):
    rng = random.Random(11)

    def passage(n, size):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
        return " ".join(words).ljust(size, "z")[:size]

    shared = [passage(54, 377), passage(57, 399), passage(57, 400), passage(80, 559)]  # all of over 50 words
    assert all(len(p.split()) > 50 for p in shared)
    # other characters on both sides, so that no match goes beyond the passage
    texts = [f"{'0123'[k]}" * 50 + p + f"{'4567'[k]}" * 50 for p in shared for k in range(2)]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in range(8)] == [0, 0, 0, 0, 400, 400, 559, 559]
    assert [got[i].changed for i in range(8)] == [False] * 4 + [True] * 4
    for i, x in enumerate(brute.substring_removed(texts)):
        assert tuple(got[i][c] for c in COLUMNS) == (i, *x)


def test_query_equals_plain_count(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op8_suffix_dedup(spark, SF).select(COLUMNS).collect())
    assert got == sorted((r.doc_id, *x) for r, x in zip(rows, brute.substring_removed([r.text for r in rows]), strict=True))
