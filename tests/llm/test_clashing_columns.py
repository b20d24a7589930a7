"""Extra columns may have any name, also those that the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from topicweave.llm import decontaminate, packing, quality_rules, secrets, simhash, url_filter
from topicweave.operators.bounded import maybe_in

NAMES = [
    "_tk", "_at", "_own", "_word", "_bits", "_id", "_key", "_bid", "_bkey", "_text", "_lang", "_source", "_cid", "_ckey", "_found", "found", "_keys", "key",
    "text_key", "n_words", "max_symbols", "n_texts", "bucket", "ratio", "row_no", "_bucket", "_rank", "root", "fp", "best", "n", "seed", "_Tk", "_hashes", "c0",
]
NAMES = [n for i, n in enumerate(NAMES) if n.lower() not in [m.lower() for m in NAMES[:i]]]
LONG = " ".join(f"word{i}" for i in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a"), (2, LONG, "en", "a"), (2, LONG, "en", "a"), (3, LONG.replace("word", "other") + " password=hunter2secret", "en", None), (None, "short", None, "b"), (5, LONG.replace("word", "third"), "fr", "b")]
    frame = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce("lang", F.lit("-"))) for n in NAMES})


def check(docs, out, ids):
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id or 0 for r in rows) == ids
    assert all(r[n] == f"{n}:{r.lang or '-'}" for r in rows for n in NAMES)
    return rows


def test_stages_keep_all_columns(spark, docs):
    check(docs, quality_rules.keep_good(docs), [1, 2, 2, 3, 5])
    check(docs, simhash.keep_one(docs), [0, 1, 3, 5])
    bench = spark.createDataFrame([(1, LONG.replace("word", "third"))], "item_id long, text string")
    check(docs, decontaminate.drop_contaminated(docs, bench), [0, 1, 2, 2, 3])
    rows = check(docs, secrets.mask(docs), [0, 1, 2, 2, 3, 5])
    assert [r.text.endswith("[assign]") and r.n_chars == len(r.text) for r in rows if r.doc_id == 3] == [True]
    assert packing.pack_documents(docs).count() == 6


def test_repeated_rows_leave_one(spark, docs):
    twice = docs.where("doc_id = 5").union(docs.where("doc_id = 5")).union(docs.where("doc_id IS NULL")).union(docs)
    check(docs, simhash.keep_one(twice), [0, 1, 3, 5])


def test_other_operators(spark, docs):
    judged = quality_rules.judge(docs)
    assert judged.count() == 6 and set(NAMES) - set(quality_rules.COUNTS) <= set(judged.columns)
    pages = docs.withColumn("url", F.lit("http://example.com/de/x")).drop("text")
    rows = url_filter.filter_urls(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect()
    assert len(rows) == 6 and all(r.verdict == "block" and r["_keys"] == f"_keys:{r.lang or '-'}" for r in rows)
    same = maybe_in(docs, docs.select("text").limit(1), "text")
    assert same.columns == docs.columns
