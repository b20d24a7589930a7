import pytest
from pyspark.sql import functions as F

from topicweave.operators import bounded, curate, profile
from topicweave.plans.jobs import dedup_articles


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_keep_first_treats_null_as_one_key(frame):
    data = [(0, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, None, "z"), (4, None, "w")]
    df = frame(data, "pos int, link string, title string")
    first = curate.keep_first(df, "link", "pos")
    assert rows(first, "pos") == [(0,), (2,), (3,)]
    assert rows(curate.keep_first(first, "title", "pos"), "pos") == [(0,), (3,)]
    assert rows(curate.keep_first(df, "link", "pos", digest=True), "pos") == [(0,), (2,), (3,)]
    assert rows(curate.duplicate_rows(df, "link", "pos"), "pos") == [(0,), (1,), (3,), (4,)]


def test_two_pass_dedup_keeps_splits_apart(frame):
    data = [("train", 0, "a", "t"), ("train", 1, "a", "u"), ("test", 2, "a", "t"), ("train", 3, "b", "t")]
    df = frame(data, "split string, pos int, link string, title string")
    assert rows(dedup_articles(df, "split", "pos"), "pos") == [(0,), (2,)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_counted_join_equals_plain_join(spark, limit):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"))
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 2)
    got = bounded.counted_join(df, counts, ["k"], "inner", F.col("id"), share=10, max_rows=limit)
    want = df.alias("d").join(counts.alias("c"), F.expr("d.k <=> c.k")).select("id", "v")
    assert rows(got, "id", "v") == rows(want, "id", "v")
    assert got.columns == ["id", "k", "n", "v"]
    rare = counts.where("k is null or k < 5")
    semi = bounded.counted_join(df, rare, ["k"], "left_semi", F.col("id"), share=10, max_rows=limit)
    assert rows(semi, "id") == rows(df.where("k is null or k < 5"), "id")


def test_keep_first_in_one_pass(frame):
    data = [(0, "a", "x"), (1, "a", "y"), (2, None, "z"), (3, None, "w")]
    got = curate.keep_first(frame(data, "pos int, link string, title string"), "link", "pos", columns=["title"])
    assert rows(got, "pos", "title") == [(0, "x"), (2, "z")]


@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_join_same_with_and_without_broadcast(spark, limit):
    df = spark.range(500).withColumn("k", F.col("id") % 7)
    dim = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = bounded.join_lookup(df, dim, ["k"], "left", spread=F.col("id"), max_rows=limit)
    assert rows(got.fillna(-1), "id", "k", "v") == [(i, i % 7, i % 7 * 10 if i % 7 < 5 else -1) for i in range(500)]


def test_publisher_first_domain_wins(frame):
    df = frame([(1, "http://dantri.com.vn/?from=vnexpress.net"), (2, "http://tuoitre.vn"), (3, None), (4, "x")], "i int, link string")
    assert rows(df.select("i", curate.publisher(F.col("link")).alias("s")), "i", "s") == [
        (1, "VnExpress"), (2, "TuoiTre Online"), (3, "Other"), (4, "Other"),
    ]


def test_publisher_join_equals_conditions(spark, frame):
    df = frame([(1, "http://dantri.com.vn/?from=vnexpress.net"), (2, "http://a.b"), (3, None), (4, "n.vn")], "i int, link string")
    dim = frame([(0, "vnexpress.net", "V"), (1, "dantri.com", "D"), (2, "n.vn", "N")], "prio int, domain string, name string")
    want = [(1, "V"), (2, "Other"), (3, "Other"), (4, "N")]
    assert rows(curate.publisher_from_table(df, "link", "i", dim), "i", "source") == want
    assert rows(curate.publisher_by_gram(df, "link", "i", dim), "i", "source") == want


def test_site_filter_literal_and_pattern(frame):
    df = frame([("vnexpressXnet",), ("vnexpress.net",), (None,)], "link string")
    assert curate.from_site(df, "link", "vnexpress.net").count() == 1
    assert curate.from_site(df, "link", "vnexpress.net", regex=True).count() == 2


def test_first_match_is_required(frame):
    df = frame([(5, "a"), (7, "b"), (9, "b")], "pos int, link string")
    assert rows(curate.from_first_match(df, "pos", F.col("link") == "b"), "pos") == [(7,), (9,)]
    with pytest.raises(ValueError):
        curate.from_first_match(df, "pos", F.col("link") == "c")


def test_article_text(frame):
    df = frame([("t", None, "3"), (None, "c", "4")], "title string, content string, label string")
    assert rows(curate.article_text(df), "text", "label") == [(" </s> c", 4), ("t </s> ", 3)]
    assert rows(curate.article_text(df.drop("content")), "text") == [("",), ("t",)]
    with pytest.raises(ValueError):
        curate.article_text(df.drop("title"))


def test_bad_label_raises(frame):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        curate.article_text(frame([("t", "x")], "title string, label string")).collect()


def test_label_names_and_fallback(frame):
    got = curate.label_names(frame([(0,), (12,), (13,)], "label int"), "label")
    assert rows(got, "label", "label_name") == [(0, "Công nghệ"), (12, "Đời sống"), (13, "Lớp 13")]


def test_union_checks_columns(frame):
    a, b = frame([(1, "x")], "p int, t string"), frame([(2, "y")], "p int, t string")
    assert rows(curate.union_checked([a, b], pos="p"), "src_ord", "p") == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        curate.union_checked([a, b.select("t", "p")])


def test_todo_and_enrich_keep_null_links(frame):
    df = frame([(1, "a"), (2, None), (3, "b")], "i int, link string")
    assert rows(curate.todo_rows(df, frame([("a",), (None,)], "link string"), "link"), "i") == [(2,), (3,)]
    got = curate.enrich(df, frame([("a", "d")], "link string, description string"), "link", "description")
    assert rows(got, "i", "description") == [(1, "d"), (2, ""), (3, "")]


def test_crosstab_fills_zero(frame):
    df = frame([("a", 1), ("a", 1), ("b", 2), ("b", None), (None, 1)], "source string, label int")
    assert rows(profile.crosstab(df, "source", "label", [1, 2, 3]), "source", "label_1", "label_2", "label_3") == [
        ("a", 2, 0, 0), ("b", 0, 1, 0),
    ]


def test_missing_ratio_of_empty_table(frame):
    got = profile.missing_ratio(frame([], "a string"), ["a"]).collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, None)]


def test_keep_first_with_a_null_split_is_the_same_with_and_without_columns(frame):
    data = [(0, None, "x", "a"), (1, None, "x", "b"), (2, "s", "x", "c"), (3, None, None, "d"), (4, "s", "x", "e"), (5, None, None, "f")]
    df = frame(data, "pos int, split string, t string, extra string")
    want = [(0,), (2,), (3,)]
    assert rows(curate.keep_first(df, "t", "pos", ["split"]), "pos") == want
    assert rows(curate.keep_first(df, "t", "pos", ["split"], columns=["extra"]), "pos") == want
    assert rows(curate.keep_first(df, "t", "pos", ["split"], digest=True), "pos") == want


@pytest.mark.parametrize("domain", ["", None])
@pytest.mark.parametrize("limit", [0, 500])
def test_an_empty_domain_is_an_error_on_both_paths(frame, monkeypatch, domain, limit):
    monkeypatch.setattr(curate, "MAX_DICTIONARY", limit)
    df = frame([(1, "http://a.b")], "i int, link string")
    dim = frame([(0, "a.b", "A"), (1, domain, "All")], "prio int, domain string, name string")
    with pytest.raises(ValueError):
        curate.publisher_from_table(df, "link", "i", dim)


def test_a_side_too_wide_is_not_small(frame, monkeypatch):
    df = frame([("x" * 5000,)] * 10, "t string")
    assert bounded.small_or_none(df).count() == 10
    monkeypatch.setattr(bounded, "MAX_BROADCAST_BYTES", 20_000)
    assert bounded.small_or_none(df) is None
