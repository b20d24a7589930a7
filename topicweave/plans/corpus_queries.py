"""Curation, profiling, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions.fixed_values import DEFAULT_SEED, LABEL_NAMES, UNKNOWN_LABEL_PREFIX
from topicweave.functions.text import clean, is_blank, lower
from topicweave.operators import curate as cu
from topicweave.operators import profile as pr
from topicweave.operators import sampling as sp
from topicweave.operators.groups import least, per_group
from topicweave.operators.ranking import cut_points, position_bucket, sample_key
from topicweave.plans.catalog import ARTICLES, WS, articles, clean_sql, key_sql, query, row_work, table
from topicweave.plans.jobs import dedup_articles
from topicweave.session import scratch_path
from topicweave.sources import csv_tables as cs
from topicweave.sources.append_sink import append_committed
from topicweave.sources.tables import read_features, write_features

LANGS = ["en", "fr", "de", "es"]
# an ordered domain dictionary for the test pages
SITES = [("blog.", "Blogs"), ("example.com", "Example Com"), ("example.org", "Example Org")]
SITES_SQL = (
    "CASE WHEN contains(url, 'blog.') THEN 'Blogs' WHEN contains(url, 'example.com') THEN 'Example Com' "
    "WHEN contains(url, 'example.org') THEN 'Example Org' ELSE 'Other' END"
)


def page_lang():
    return F.regexp_extract("html", '<html lang="([a-z]+)"', 1)


PAGE_LANG_SQL = "regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)"


# --- scans, filters, projections -------------------------------------------------------------------------------------


@query("table_shape", "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM documents")
def table_shape(spark, d):
    return pr.shape(table(spark, d, "documents"))


@query("preview", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")
def preview(spark, d):
    return cu.preview(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", 5)


@query("field_at", "SELECT doc_id, text FROM documents WHERE doc_id = 1")
def field_at(spark, d):
    return cu.field_at(table(spark, d, "documents"), "doc_id", 1, "text")


@query("site_filter", "SELECT page_id, url FROM pages WHERE contains(url, 'example.net')")
def site_filter(spark, d):
    return cu.from_site(table(spark, d, "pages").select("page_id", "url"), "url", "example.net")


@query("site_filter_regex", "SELECT page_id, url FROM pages WHERE regexp_matches(url, 'g.th')")
def site_filter_regex(spark, d):
    return cu.from_site(table(spark, d, "pages").select("page_id", "url"), "url", "g.th", regex=True)


@query("label_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es')")
def label_filter(spark, d):
    return cu.with_labels(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["de", "es"])


@query(
    "rows_from_match",
    "SELECT doc_id, source FROM documents WHERE doc_id >= (SELECT min(doc_id) FROM documents WHERE source = 'src7')",
)
def rows_from_match(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return cu.from_first_match(docs, "doc_id", F.col("source") == "src7")


@query(
    "split_by_blank",
    f"WITH {ARTICLES} SELECT row_pos, content IS NULL OR NOT regexp_matches(content, '[^{WS}]') AS is_blank FROM articles",
)
def split_by_blank(spark, d):
    return cu.split_blank(articles(spark, d), "content").select("row_pos", "is_blank")


@query(
    "missing_ratio",
    f"""WITH {ARTICLES}, m AS (
      SELECT 'label' AS column_name, count(*) AS rows, count(*) FILTER (WHERE label IS NULL) AS missing FROM articles
      UNION ALL SELECT 'content', count(*), count(*) FILTER (WHERE content IS NULL) FROM articles)
    SELECT column_name, rows, missing, round(missing * 100.0 / rows, 2) AS missing_pct FROM m""",
)
def missing_ratio(spark, d):
    return pr.missing_ratio(articles(spark, d), ["label", "content"])


@query("missing_rows", f"WITH {ARTICLES} SELECT row_pos, title FROM articles WHERE content IS NULL")
def missing_rows(spark, d):
    return articles(spark, d).where(F.col("content").isNull()).select("row_pos", "title")


@query("detect_source", f"SELECT page_id, {SITES_SQL} AS source FROM pages")
def detect_source(spark, d):
    return table(spark, d, "pages").select("page_id", cu.publisher(F.col("url"), SITES).alias("source"))


@query(
    "article_text",
    f"""WITH {ARTICLES} SELECT row_pos, coalesce(title, '') || ' </s> ' || coalesce(content, '') AS text,
        CAST(label AS INTEGER) AS label FROM articles""",
)
def article_text(spark, d):
    return cu.article_text(articles(spark, d)).select("row_pos", "text", "label")


@query("title_text", f"WITH {ARTICLES} SELECT row_pos, coalesce(title, '') AS text FROM articles")
def title_text(spark, d):
    return cu.article_text(articles(spark, d).drop("content")).select("row_pos", "text")


@query(
    "label_lookup",
    f"""SELECT c_custkey, c_nationkey AS label, coalesce(name, '{UNKNOWN_LABEL_PREFIX}' || c_nationkey) AS label_name
    FROM customer LEFT JOIN (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(LABEL_NAMES))}) v(code, name)
      ON c_nationkey = code""",
)
def label_lookup(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("label"))
    return cu.label_names(rows, "label")


# --- de-duplication --------------------------------------------------------------------------------------------------

FIRST_TEXT = """SELECT doc_id, lang, source, text FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""


@query("dedup_keep_first", f"SELECT doc_id, lang, source FROM ({FIRST_TEXT})")
def dedup_keep_first(spark, d):
    return cu.keep_first(table(spark, d, "documents"), "text", "doc_id", ["lang"], digest=True, columns=["source"])


NULL_SPLIT = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END"


@query(
    "dedup_null_split",
    f"""SELECT doc_id, part, source FROM (SELECT doc_id, {NULL_SPLIT} AS part, source,
      row_number() OVER (PARTITION BY {NULL_SPLIT}, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def dedup_null_split(spark, d):
    """A third of the rows without a split: they form one split of their own."""
    part = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    rows = table(spark, d, "documents").select("doc_id", part.alias("part"), "source", "text")
    return cu.keep_first(rows, "text", "doc_id", ["part"], digest=True).drop("text")


@query(
    "dedup_two_keys",
    f"""WITH {ARTICLES}, a AS (SELECT *, row_number() OVER (PARTITION BY lang, content ORDER BY row_pos) AS r1 FROM articles),
      b AS (SELECT *, row_number() OVER (PARTITION BY lang, title ORDER BY row_pos) AS r2 FROM a WHERE r1 = 1)
    SELECT row_pos, lang, title FROM b WHERE r2 = 1""",
)
def dedup_two_keys(spark, d):
    rows = articles(spark, d).select("row_pos", "lang", "title", "content")
    return dedup_articles(rows, "lang", "row_pos", "content", "title").select("row_pos", "lang", "title")


@query(
    "dedup_steps",
    f"""WITH {ARTICLES}, a AS (SELECT *, row_number() OVER (PARTITION BY lang, content ORDER BY row_pos) AS r1 FROM articles),
      b AS (SELECT *, row_number() OVER (PARTITION BY lang, title ORDER BY row_pos) AS r2 FROM a WHERE r1 = 1),
      n AS (SELECT (SELECT count(*) FROM a) AS n0, (SELECT count(*) FROM b) AS n1, (SELECT count(*) FROM b WHERE r2 = 1) AS n2)
    SELECT 'all' AS step, n0 AS n_rows, CAST(4 AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS removed FROM n
    UNION ALL SELECT 'first of link', n1, CAST(4 AS BIGINT), n0 - n1 FROM n
    UNION ALL SELECT 'first of title', n2, CAST(4 AS BIGINT), n1 - n2 FROM n""",
)
def dedup_steps(spark, d):
    """Rows before, between and after the two passes of a de-duplication, counted by the job itself."""
    rows = articles(spark, d).select("row_pos", "lang", "title", "content")
    report = pr.StepReport()
    dedup_articles(rows, "lang", "row_pos", "content", "title", report)
    return report.table(spark)


@query(
    "dup_report",
    "SELECT doc_id, lang FROM (SELECT *, count(*) OVER (PARTITION BY lang, text) AS n FROM documents) WHERE n > 1",
)
def dup_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return cu.duplicate_rows(docs, "text", "doc_id", ["lang"], digest=True).drop("text")


@query(
    "dup_report_null_key",
    f"""WITH {ARTICLES} SELECT row_pos, label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM articles)
    WHERE n > 1""",
)
def dup_report_null_key(spark, d):
    return cu.duplicate_rows(articles(spark, d).select("row_pos", "label"), "label", "row_pos")


@query(
    "dup_summary",
    """SELECT lang, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicated_rows,
      count(*) AS rows_left FROM (SELECT lang, text, count(*) AS n FROM documents GROUP BY lang, text) GROUP BY lang""",
)
def dup_summary(spark, d):
    return cu.duplicate_summary(table(spark, d, "documents"), "text", ["lang"], digest=True)


# --- counts ----------------------------------------------------------------------------------------------------------


@query("label_counts", f"WITH {ARTICLES} SELECT label, count(*) AS n FROM articles WHERE label IS NOT NULL GROUP BY label")
def label_counts(spark, d):
    return pr.label_counts(articles(spark, d), "label")


@query("label_counts_desc", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def label_counts_desc(spark, d):
    return pr.label_counts(table(spark, d, "documents"), "source", by_count=True)


@query("smallest_class", "SELECT min(n) AS min_n FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def smallest_class(spark, d):
    return pr.smallest_class(table(spark, d, "documents"), "source")


@query("distinct_labels", "SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark, d):
    return pr.distinct_labels(table(spark, d, "embeddings"), "label")


def _crosstab_sql(rows: str, source: str) -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE lang = '{v}') AS label_{v}" for v in LANGS)
    return f"SELECT {rows}, {cells} FROM {source} GROUP BY {rows}"


@query("source_label_crosstab", _crosstab_sql("source", "documents"))
def source_label_crosstab(spark, d):
    return pr.crosstab(table(spark, d, "documents"), "source", "lang", LANGS)


@query(
    "publisher_label_crosstab",
    _crosstab_sql("source", f"(SELECT {SITES_SQL} AS source, {PAGE_LANG_SQL} AS lang FROM pages)"),
)
def publisher_label_crosstab(spark, d):
    rows = table(spark, d, "pages").select(cu.publisher(F.col("url"), SITES).alias("source"), page_lang().alias("lang"))
    return pr.crosstab(rows, "source", "lang", LANGS)


LINE_NUMBERS = [1, 2, 3, 4, 5, 6, 7, 9]


@query(
    "lineitem_flag_crosstab",
    f"""SELECT l_returnflag, {", ".join(f"count(*) FILTER (WHERE l_linenumber = {n}) AS label_{n}" for n in LINE_NUMBERS)}
    FROM lineitem GROUP BY l_returnflag""",
)
def lineitem_flag_crosstab(spark, d):
    """All line numbers there are, and one that no row has."""
    return pr.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", LINE_NUMBERS)


def flagship(spark, d):
    """Clean, keep the first of each cleaned text per language, drop blanks, name the source, cross-tabulate."""
    docs = row_work(spark, d, "documents").select("doc_id", "lang", "source", "text")
    cleaned = docs.withColumn("text", clean(lower(F.col("text")))).withColumn("blank", is_blank(F.col("text")))
    kept = cu.keep_first(cleaned, "text", "doc_id", ["lang"], digest=True, columns=["source", "blank"])
    groups = [("src1", "Group One"), ("src2", "Group Two")]
    named = kept.where("not blank").withColumn("source", cu.publisher(F.col("source"), groups))
    return pr.crosstab(named, "source", "lang", LANGS)


query(
    "curated_crosstab",
    f"""WITH c AS (SELECT doc_id, lang, source, {clean_sql("lower(text)")} AS text FROM documents),
      k AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM c WHERE text <> '')
    {_crosstab_sql("source", '''(SELECT lang, CASE WHEN contains(source, 'src1') THEN 'Group One'
      WHEN contains(source, 'src2') THEN 'Group Two' ELSE 'Other' END AS source FROM k WHERE rn = 1)''')}""",
)(flagship)


# --- samples, splits, folds ------------------------------------------------------------------------------------------


def _sample_sql(n: str, label: str, row_id: str, source: str) -> str:
    return f"""SELECT {row_id}, {label} FROM (SELECT *, row_number() OVER (
      PARTITION BY {label} ORDER BY {key_sql(row_id)}, {row_id}) AS rk FROM {source}) WHERE rk <= {n}"""


@query("undersample_n", _sample_sql("10", "lang", "doc_id", "documents"))
def undersample_n(spark, d):
    return sp.undersample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 10, "doc_id")


@query("undersample_hook", _sample_sql("10", "lang", "doc_id", "documents"))
def undersample_hook(spark, d):
    """The same sample by a function per group that streams through the groups."""
    keyed = table(spark, d, "documents").select("doc_id", "lang", sample_key(DEFAULT_SEED, "doc_id").alias("key"))
    return per_group(keyed.where("lang IS NOT NULL"), ["lang"], least(10, ["key", "doc_id"]), combine=True).drop("key")


@query(
    "undersample_site_labels",
    f"""WITH s AS (SELECT page_id, {PAGE_LANG_SQL} AS lang FROM pages WHERE contains(url, 'example.com'))
    {_sample_sql("10", "lang", "page_id", "(SELECT * FROM s WHERE lang IN ('en', 'fr', 'de'))")}""",
)
def undersample_site_labels(spark, d):
    site = cu.from_site(table(spark, d, "pages"), "url", "example.com").select("page_id", page_lang().alias("lang"))
    return sp.undersample(cu.with_labels(site, "lang", ["en", "fr", "de"]), "lang", 10, "page_id")


@query(
    "balance_min",
    _sample_sql("(SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))", "lang", "doc_id", "documents"),
)
def balance_min(spark, d):
    return sp.balance(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(
    "balance_events",
    _sample_sql(
        "(SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))", "event_type", "event_id", "events"
    ),
)
def balance_events(spark, d):
    return sp.balance(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(
    "shuffle_order",
    f"SELECT doc_id, row_number() OVER (ORDER BY {key_sql('doc_id')}, doc_id) - 1 AS row_pos FROM documents",
)
def shuffle_order(spark, d):
    return sp.shuffle_rows(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    "sample_cap",
    f"SELECT event_id, event_type FROM events ORDER BY {key_sql('event_id')}, event_id LIMIT 3000",
)
def sample_cap(spark, d):
    return sp.sample_rows(table(spark, d, "events").select("event_id", "event_type"), 3000, "event_id")


TAIL = """t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents
  WHERE doc_id >= (SELECT min(doc_id) FROM documents WHERE source = 'src7')),
  p AS (SELECT doc_id, CAST(i // CAST(ceil(n / 4.0) AS BIGINT) AS INTEGER) AS part FROM t)"""


def _tail_parts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    tail = cu.from_first_match(docs, "doc_id", F.col("source") == "src7")
    return sp.split_contiguous(tail, 4, "doc_id")


@query("split_ceil", f"WITH {TAIL} SELECT doc_id, part FROM p")
def split_ceil(spark, d):
    return _tail_parts(spark, d).select("doc_id", "part")


@query(
    "partitioned_sink",
    f"WITH {TAIL} SELECT part, min(doc_id) AS first_pos, max(doc_id) AS last_pos, count(*) AS n FROM p GROUP BY part",
)
def partitioned_sink(spark, d):
    path = scratch_path(spark, "parts")
    cs.write_partitioned(_tail_parts(spark, d), path, "part")
    return sp.part_manifest(spark.read.parquet(path), "part", "doc_id")


def split_sql(label: str, row_id: str, source: str) -> str:
    return f"""WITH c AS (SELECT {label}, count(*) AS n FROM {source} GROUP BY {label}),
      t AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_test FROM c),
      q AS (SELECT {label}, n * n_test // total AS fl, n * n_test % total AS rem, n_test FROM c, t),
      k AS (SELECT {label}, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, {label}) <= n_test - sum(fl) OVER ()
        THEN 1 ELSE 0 END AS quota FROM q),
      r AS (SELECT {row_id}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {key_sql(row_id)}, {row_id}) AS rk
        FROM {source})
    SELECT {row_id}, {label}, CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN k USING ({label})"""


@query("stratified_split", split_sql("label", "vec_id", "embeddings"))
def stratified_split(spark, d):
    return sp.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("stratified_split_docs", split_sql("source", "doc_id", "documents"))
def stratified_split_docs(spark, d):
    return sp.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


def folds_sql(offset_order: str, rank_order: str) -> str:
    return f"""c AS (SELECT label, count(*) AS n, min(vec_id) AS f0 FROM embeddings GROUP BY label),
      o AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY {offset_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        0) AS o FROM c),
      a AS (SELECT label, f, (n + 4 - ((f - o) % 5 + 5) % 5) // 5 AS size FROM o, range(5) g(f)),
      u AS (SELECT label, f, sum(size) OVER (PARTITION BY label ORDER BY f) AS upto FROM a),
      r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {rank_order}) AS rk FROM embeddings),
      folds AS (SELECT vec_id, label, CAST(count(*) FILTER (WHERE rk > upto) AS INTEGER) AS fold
        FROM r JOIN u USING (label) GROUP BY vec_id, label)"""


BLOCK_FOLDS = folds_sql("f0", "vec_id")


@query("kfold_shuffled", f"WITH {folds_sql('label', key_sql('vec_id') + ', vec_id')} SELECT * FROM folds")
def kfold_shuffled(spark, d):
    return sp.stratified_folds(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("kfold_blocks", f"WITH {BLOCK_FOLDS} SELECT * FROM folds")
def kfold_blocks(spark, d):
    return sp.stratified_blocks(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query(
    "train_prefixes",
    f"""WITH {BLOCK_FOLDS}, t AS (SELECT g.f AS train_of, vec_id, row_number() OVER (PARTITION BY g.f ORDER BY vec_id) AS rk
        FROM folds, range(5) g(f) WHERE fold <> g.f),
      s AS (SELECT x.f AS frac, CAST(floor(x.f * (SELECT count(*) FROM folds WHERE fold <> 0)) AS BIGINT) AS quota
        FROM (VALUES (CAST(0.1 AS DOUBLE)), (0.325), (0.55), (0.775), (1.0)) x(f))
    SELECT CAST(train_of AS INTEGER) AS train_of, quota, max(vec_id) AS last_pos FROM t JOIN s ON rk <= quota
    GROUP BY train_of, quota""",
)
def train_prefixes(spark, d):
    folded = sp.stratified_blocks(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")
    others = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i != F.col("fold"))
    rows = folded.select("vec_id", F.explode(others).alias("train_of"))
    n = folded.where("fold <> 0").count()
    wanted = [(f, int(x * n)) for f in range(5) for x in (0.1, 0.325, 0.55, 0.775, 1.0)]
    quotas = spark.createDataFrame(wanted, "train_of int, quota bigint")
    rows = rows.withColumn("_bucket", position_bucket(folded, "vec_id"))
    cuts = cut_points(rows, ["train_of"], "_bucket", ["vec_id"], quotas)
    ends = rows.groupBy("train_of").agg(F.max("vec_id").alias("_end"))
    last = F.coalesce("cut_vec_id", "_end").alias("last_pos")
    return cuts.join(ends, "train_of").select("train_of", "quota", last)


# --- unions and joins ------------------------------------------------------------------------------------------------


@query(
    "union_checked",
    """SELECT 0 AS src_ord, doc_id, length(text) AS n FROM documents WHERE lang = 'en'
    UNION ALL SELECT 1, item_id, length(text) FROM benchmark""",
)
def union_checked(spark, d):
    docs = cu.with_labels(table(spark, d, "documents"), "lang", ["en"]).select("doc_id", "text")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    both = cu.union_checked([docs, bench], pos="doc_id")
    return both.select("src_ord", "doc_id", F.length("text").cast("bigint").alias("n"))


@query(
    "union_by_name",
    """SELECT conv_id, turn, role, CAST(NULL AS BIGINT) AS item_id, text FROM conversations
    UNION ALL SELECT NULL, NULL, NULL, item_id, text FROM benchmark""",
)
def union_by_name(spark, d):
    return cu.union_by_name([table(spark, d, "conversations"), table(spark, d, "benchmark")])


@query(
    "label_domain_union",
    f"SELECT DISTINCT lang AS label FROM documents UNION SELECT {PAGE_LANG_SQL} FROM pages",
)
def label_domain_union(spark, d):
    return cu.label_domain(table(spark, d, "documents").select("lang"), table(spark, d, "pages").select(page_lang()))


@query(
    "todo_anti_join",
    "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def todo_anti_join(spark, d):
    return cu.todo_rows(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query(
    "enrich_left",
    """SELECT doc_id, lang, coalesce('quality ' || quality, '') AS note FROM documents LEFT JOIN labels USING (doc_id)""",
)
def enrich_left(spark, d):
    notes = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality")).alias("note"))
    return cu.enrich(table(spark, d, "documents").select("doc_id", "lang"), notes, "doc_id", "note")


HOSTS_SQL = """h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS domain FROM pages),
  k AS (SELECT row_number() OVER (ORDER BY length(domain) DESC, domain) AS prio, domain, upper(domain) AS name FROM h)"""


def _hosts(spark, d):
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("domain")).distinct()
    # priority by length, then name, as one sortable text
    prio = F.concat(F.lpad((10_000 - F.length("domain")).cast("string"), 5, "0"), F.lit(":"), F.col("domain"))
    return hosts.select(prio.alias("prio"), "domain", F.upper("domain").alias("name"))


DOMAIN_JOIN = f"""WITH {HOSTS_SQL} SELECT page_id, coalesce(arg_min(name, prio), 'Other') AS source
  FROM pages LEFT JOIN k ON contains(url, domain) GROUP BY page_id"""


@query("domain_theta_join", DOMAIN_JOIN)
def domain_theta_join(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return cu.publisher_from_table(pages, "url", "page_id", _hosts(spark, d)).drop("url")


@query("domain_gram_join", DOMAIN_JOIN)
def domain_gram_join(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return cu.publisher_by_gram(pages, "url", "page_id", _hosts(spark, d)).drop("url")


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT doc_id, lang, nullif(text, '') AS text, n_chars FROM documents")
def csv_round_trip(spark, d):
    """Written as quoted CSV chunks and read back with line breaks and quotes intact."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars")
    path = scratch_path(spark, "csv")
    cs.append_csv(docs, path)
    return cs.read_csv(spark, path, docs.schema)


@query("csv_append", "SELECT doc_id, lang, nullif(text, '') AS text, n_chars FROM documents UNION ALL SELECT page_id, NULL, url, length(html) FROM pages")
def csv_append(spark, d):
    """Two committed appends to one place, read back as one table."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars")
    pages = table(spark, d, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.col("url").alias("text"), F.length("html").cast("bigint").alias("n_chars")
    )
    path = scratch_path(spark, "csv-append")
    for part in (docs, pages):
        append_committed(part, path)
    return cs.read_csv(spark, path, docs.schema, glob="*.csv")


@query("csv_ingest", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_pos, event_id, event_type FROM events")
def csv_ingest(spark, d):
    """CSV files in file-name order become a parquet table with row positions."""
    events = table(spark, d, "events").select("event_id", "event_type")
    path, target = scratch_path(spark, "csv"), scratch_path(spark, "table")
    cs.write_csv(events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), path)
    return cs.ingest_csv(spark, path, events.schema, target)


def millionths(vec: str):
    """Exact sum of the entries of a vector, each cut to whole millionths."""
    parts = F.transform(vec, lambda v: F.floor(v.cast("double") * 1000000))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, v: a + v)


MILLIONTHS = "list_sum(list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000000) AS BIGINT)))"


@query(
    "feature_table",
    f"""SELECT vec_id, s.label, split, CAST({MILLIONTHS} AS BIGINT) AS vector_sum, CAST(len(embedding) AS INTEGER) AS dim
    FROM ({split_sql("label", "vec_id", "embeddings")}) s JOIN embeddings USING (vec_id)""",
)
def feature_table(spark, d):
    """Feature table stored by split; each split is read by its own partition filter. Vectors are told by an exact sum."""
    path = scratch_path(spark, "features")
    write_features(sp.stratified_split(table(spark, d, "embeddings"), "label", "vec_id"), path)
    both = read_features(spark, path, "train").unionByName(read_features(spark, path, "test"))
    return both.select("vec_id", "label", "split", millionths("embedding").alias("vector_sum"), F.size("embedding").alias("dim"))
