import os

import pytest
from pyspark.sql.types import IntegerType, StringType, StructType

from topicweave.operators.extract import enrich_from_pages
from topicweave.session import scratch_path, shared_dir
from topicweave.sources import csv_tables as cs
from topicweave.sources import tables
from topicweave.streaming.enrich import stream_enrich

SCHEMA = StructType().add("title", StringType()).add("link", StringType()).add("label", IntegerType())


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_missing_texts_quotes_and_breaks(spark, tmp_path):
    path = str(tmp_path / "in" / "a.csv")
    write(path, '﻿title,link,label\n"a ""q"", b\nc",NA,1\nnan,"",2\nx,l,\n')
    got = [tuple(r) for r in cs.read_csv(spark, path, SCHEMA).collect()]
    assert got == [('a "q", b\nc', None, 1), (None, None, 2), ("x", "l", None)]


def test_csv_bad_number_raises(spark, tmp_path):
    path = str(tmp_path / "in" / "a.csv")
    write(path, "title,link,label\nx,l,three\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cs.read_csv(spark, path, SCHEMA).collect()


def test_directory_is_read_in_file_name_order(spark, tmp_path):
    for name, first in (("chunk_2.csv", 10), ("chunk_1.csv", 0), ("chunk_3.csv", 20)):
        write(str(tmp_path / "in" / name), "title,link,label\n" + "".join(f"t{first + i},l,{i}\n" for i in range(5 if first else 7)))
    write(str(tmp_path / "in" / "note.txt"), "not a table")
    got = cs.ingest_csv(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out")).orderBy("row_pos").collect()
    assert [r["row_pos"] for r in got] == list(range(17))
    want = [f"t{i}" for i in range(7)] + [f"t{i}" for i in range(10, 15)] + [f"t{i}" for i in range(20, 25)]
    assert [r["title"] for r in got] == want


def test_append_and_partitioned_writes(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 'q"q', 1), ("c", None, 2)], SCHEMA)
    for _ in range(2):
        cs.append_csv(df, str(tmp_path / "csv"))
    assert cs.read_csv(spark, str(tmp_path / "csv"), SCHEMA).count() == 4
    cs.write_partitioned(df, str(tmp_path / "parts"), "label", as_csv=True)
    assert sorted(p for p in os.listdir(tmp_path / "parts") if p.startswith("label")) == ["label=1", "label=2"]


def test_features_without_split(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5], 0)], "id bigint, features array<float>, label int")
    tables.write_features(df, str(tmp_path / "f"))
    assert tables.read_features(spark, str(tmp_path / "f"), "all").count() == 1
    assert tables.read_features(spark, str(tmp_path / "f"), "test").count() == 0


def test_words(spark, tmp_path):
    write(str(tmp_path / "w" / "stop.txt"), "và\n của \n\nlà\t\n")
    assert [r["word"] for r in tables.read_words(spark, str(tmp_path / "w" / "stop.txt")).collect()] == ["và", "của", "là"]


PAGE = '<html><p class="description">about {}</p></html>'


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    schema = "title string, link string, label int"
    pages = spark.createDataFrame(
        [(i, f"http://vnexpress.net/{i}", PAGE.format(i)) for i in range(6)] + [(9, "http://vnexpress.net/9", "<p>none")],
        "page_id int, url string, html string",
    )
    links = [f"http://vnexpress.net/{i}" for i in (0, 1, 1, 2, 9, 77)] + ["http://other.org/1"]
    articles = spark.createDataFrame([(f"t{link}", link, 1) for link in links], schema)
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    articles.coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_enrich(stream, pages, out, state, "vnexpress.net").awaitTermination()
        return sorted((r["link"], r["description"]) for r in spark.read.parquet(out).collect())

    first = run()
    batch = enrich_from_pages(articles, pages, None, "vnexpress.net")
    assert len(first) == 6  # every row, the repeated link twice
    assert first == sorted((r["link"], r["description"]) for r in batch.collect())
    assert dict(first)["http://vnexpress.net/2"] == "about 2" and dict(first)["http://vnexpress.net/9"] == ""
    assert run() == first
    extra = [("t", "http://vnexpress.net/1", 1), ("t", "http://vnexpress.net/4", 1)]
    spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == sorted([*first, ("http://vnexpress.net/4", "about 4")])


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)


def test_html_is_never_shuffled_and_errors_are_kept(spark, monkeypatch):
    from topicweave.operators import extract

    pages = spark.createDataFrame([(f"u{i}", PAGE.format(i)) for i in range(40)] + [("u1", "<p>"), ("bad", "boom")], "url string, html string")
    articles = spark.createDataFrame([(i, f"u{i % 50}") for i in range(200)] + [(900, "bad"), (901, None)], "i int, link string")

    def read(page, *target):
        if page == "boom":
            raise ValueError("cannot read")
        return page

    monkeypatch.setattr(extract, "first_element_text", read)
    got = extract.enrich_from_pages(articles, pages)
    rows = {r["i"]: r for r in got.collect()}
    assert len(rows) == 202 and rows[900]["error"] == "ValueError: cannot read" and rows[900]["description"] == ""
    assert rows[901]["description"] == "" and rows[1]["error"] is None and rows[199]["description"] == ""
    plan = got._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "html" not in line
    under = plan.split("MapInArrow")[1:]
    assert under and not any("Exchange hashpartitioning(url" in part.split("Scan")[0] and "html" in part for part in under)


def test_bitmap_keeps_every_wanted_key(spark):
    from topicweave.operators.bounded import maybe_in

    rows = spark.range(20000).selectExpr("cast(id as string) AS k")
    kept = maybe_in(rows, rows.where("k % 10 = 3"), "k")
    assert kept.where("k % 10 = 3").count() == 2000 and kept.count() < 2200
    assert maybe_in(rows, rows.where("k % 10 = 3"), "k", "left_anti").count() == 20000 - kept.count()
