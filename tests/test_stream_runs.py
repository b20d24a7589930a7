"""A link repeated over several input files: every row is kept, as the batch job does, after a failure too."""

import pytest

from topicweave.operators.extract import enrich_from_pages
from topicweave.streaming import enrich

SCHEMA = "title string, link string, label int"
PAGE = '<html><p class="description">about {}</p></html>'


def rows(df):
    return sorted((r["title"], r["link"], r["description"]) for r in df.collect())


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("fails", [False, True])
def test_link_in_several_files(spark, tmp_path, monkeypatch, fails, keyed):
    pages = spark.createDataFrame([(f"u{i}", PAGE.format(i)) for i in range(4)], "url string, html string")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    files = [[("a", "u1", 1), ("b", "u2", 1)], [("c", "u1", 1)], [("d", "u1", 1), ("f", "u3", 1)]]
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        enrich.stream_enrich(stream, pages, out, state, keyed_state=keyed).awaitTermination()
        return rows(spark.read.parquet(out))

    if fails:
        calls = []

        def sometimes(*args, **more):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("lost")
            return enrich_from_pages(*args, **more)

        monkeypatch.setattr(enrich, "enrich_from_pages", sometimes)
        with pytest.raises(Exception, match="lost"):
            run()
    everything = spark.createDataFrame([x for part in files for x in part], SCHEMA)
    batch = rows(enrich_from_pages(everything, pages))
    assert len(batch) == 5 and run() == batch and run() == batch
    # a later run sees the links of this one
    spark.createDataFrame([("g", "u1", 1), ("h", "u0", 1)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run() == sorted([*batch, ("h", "u0", "about 0")])


def test_state_keeps_values_and_reads_no_history(spark, tmp_path, monkeypatch):
    """Other columns come out of the state as they went in, null links are never done, and no batch reads the output."""
    from datetime import datetime

    schema = "link string, n long, d double, t timestamp, s string, a array<int>, b binary"
    at = datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [("u1", 2**60 + 1, 0.1, at, 'q"\n', [1, None], b"\x00\xff"), (None, None, None, None, None, None, None), ("u2", -1, 1e300, at, "", [], b"")]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    pages = spark.createDataFrame([("u1", PAGE.format(1))], "url string, html string")
    monkeypatch.setattr(enrich, "finished_links", lambda *a: pytest.fail("history was read"))
    provider = spark.conf.get(enrich.PROVIDER)
    for want in (3, 4):  # the second run adds the row without link only
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        enrich.stream_enrich(stream, pages, out, state, keyed_state=True).awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == want and spark.conf.get(enrich.PROVIDER) == provider
    one = {r.link: r for r in got.collect()}
    for row in rows:
        r = one[row[0]]
        assert (r.n, r.d, r.t, r.s, r.a, r.b and bytes(r.b)) == (*row[1:6], row[6] or r.b)
    assert one["u1"].description == "about 1"


@pytest.mark.parametrize("files", [0, 3, 20])
@pytest.mark.parametrize("keyed", [False, True])
def test_query_over_file_or_folder(spark, tmp_path, monkeypatch, files, keyed):
    """The table of pages may be one file or a folder of files; the batches stay few, whatever the number of files."""
    from topicweave.plans import text_queries

    page = "<html><h1>about {}</h1></html>"
    rows = [(i, f"http://{'www.example' if i % 3 else 'other'}.org/{i}", page.format(i)) for i in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    if files:
        table.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    else:
        table.coalesce(1).write.parquet(str(tmp_path / "part"))
        next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    batches, write = set(), enrich.enrich_from_pages
    monkeypatch.setattr(enrich, "enrich_from_pages", lambda *a, **b: (batches.add(len(batches)), write(*a, **b))[1])
    got = text_queries._stream(spark, str(tmp_path), keyed_state=keyed)
    assert sorted((r.label, r.link, r.description) for r in got.collect()) == [(i, u, f"about {i}") for i, u, _ in rows if "example" in u]
    assert min(files or 1, 2) <= len(batches) <= text_queries.MAX_BATCHES
