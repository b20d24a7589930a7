"""Text normalisation and page extraction queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from topicweave.functions import text as tx
from topicweave.functions.fixed_values import CODAS, NUCLEI, ONSETS, TONED_VOWELS
from topicweave.operators import extract as ex
from topicweave.operators import lattice as lt
from topicweave.operators import lexicon as lx
from topicweave.operators import sentences as se
from topicweave.plans import jobs
from topicweave.operators.bounded import spread
from topicweave.plans.catalog import ARTICLES, WS, articles, clean_sql, query, row_work, squeeze_sql, table, words_sql
from topicweave.session import scratch_path
from topicweave.sources.tables import read_pages, read_words
from topicweave.streaming.enrich import stream_enrich

STOP = ["the", "of", "and", "la", "de", "le", "der", "und", "el"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
DECOMPOSED = "replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))"


def _decomposed():
    accents = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return F.replace(accents, F.lit("ü"), F.lit("ü"))


def _docs(spark, d):
    return row_work(spark, d, "documents").select("doc_id", "text")


@query("lower_text", "SELECT doc_id, lower(text) AS text FROM documents")
def lower_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.lower(F.col("text")).alias("text"))


@query("nfc", f"SELECT doc_id, nfc_normalize({DECOMPOSED}) AS text FROM documents")
def nfc(spark, d):
    return _docs(spark, d).select("doc_id", tx.nfc(_decomposed()).alias("text"))


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("text"))


@query("squeeze_spaces", f"SELECT doc_id, {squeeze_sql('text')} AS text FROM documents")
def squeeze_spaces(spark, d):
    return _docs(spark, d).select("doc_id", tx.squeeze(F.col("text")).alias("text"))


@query(
    "stopwords",
    f"SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda w: w NOT IN ({STOP_SQL})), ' ') AS text FROM documents",
)
def stopwords(spark, d):
    return _docs(spark, d).select("doc_id", tx.drop_words(F.col("text"), STOP).alias("text"))


@query("word_list", f"SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents")
def word_list(spark, d):
    """The distinct words of the corpus, written one a line with stray spaces, and read again as a word list."""
    path = scratch_path(spark, "words")
    words = _docs(spark, d).select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    words.select(F.concat(F.lit(" "), "word", F.lit("\t ")).alias("value")).write.text(path)
    return read_words(spark, path)


FREQUENT = f"""w AS (SELECT unnest({words_sql('text')}) AS word FROM documents),
  s AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 500)"""


@query(
    "stopwords_from_table",
    f"""WITH {FREQUENT}, l AS (SELECT list(word) AS stop FROM s)
    SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda w: NOT list_contains(stop, w)), ' ') AS text
    FROM documents, l""",
)
def stopwords_from_table(spark, d):
    """Stop words read off the corpus itself: all words seen 500 times or more."""
    docs = _docs(spark, d)
    counts = docs.select(F.explode(tx.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return lx.remove_stopwords(docs, "text", counts.where("n >= 500").select("word"), "doc_id")


@query(
    "invalid_char",
    rf"""SELECT doc_id, regexp_matches(text, '[^\p{{L}}\p{{N}}_{WS}]') AS raw_invalid,
      regexp_matches({clean_sql('text')}, '[^\p{{L}}\p{{N}}_{WS}]') AS clean_invalid FROM documents""",
)
def invalid_char(spark, d):
    raw, done = F.col("text"), tx.clean(F.col("text"))
    return _docs(spark, d).select(
        "doc_id", tx.has_invalid_char(raw).alias("raw_invalid"), tx.has_invalid_char(done).alias("clean_invalid")
    )


def _extra_space_sql(t: str) -> str:
    return f"(regexp_matches({t}, '[{WS}]{{2,}}') OR regexp_matches({t}, '^[{WS}]') OR regexp_matches({t}, '[{WS}]$'))"


@query(
    "extra_space",
    f"""WITH {ARTICLES} SELECT row_pos, {_extra_space_sql('text')} AS text_space, {_extra_space_sql('content')} AS content_space
    FROM articles""",
)
def extra_space(spark, d):
    return articles(spark, d).select(
        "row_pos",
        tx.has_extra_space(F.col("text")).alias("text_space"),
        tx.has_extra_space(F.col("content")).alias("content_space"),
    )


_VOWELS = "".join(TONED_VOWELS)


def tone_sql(expr: str) -> str:
    """The tone rule word by word, in the same three steps as the Column version."""
    syllable = f"^({'|'.join(sorted(ONSETS, key=len, reverse=True))})?([{_VOWELS}]{{2,3}})({'|'.join(sorted(CODAS, key=len, reverse=True))})?$"
    bases = "".join(v[0] * 6 for v in TONED_VOWELS)
    tones = "012345" * len(TONED_VOWELS)
    nuclei = ", ".join(f"'{n}'" for n in NUCLEI)
    split = f"lambda w: {{'w': w, 'o': regexp_extract(w, '{syllable}', 1), 'v': regexp_extract(w, '{syllable}', 2), 'k': regexp_extract(w, '{syllable}', 3)}}"
    base = f"translate(s.v, '{_VOWELS}', '{bases}')"
    mark = f"translate({base}, 'ăâêôơưaeiouy', '111111000000')"
    analyse = (
        f"lambda s: {{'w': s.w, 'o': s.o, 'k': s.k, 'b': {base}, 't': replace(translate(s.v, '{_VOWELS}', '{tones}'), '0', ''), "
        f"'p': CASE WHEN contains({mark}, '1') THEN length(s.v) - strpos(reverse({mark}), '1') + 1 WHEN s.k <> '' THEN length(s.v) "
        f"WHEN length(s.v) = 3 THEN 2 ELSE 1 END}}"
    )
    rebuild = (
        f"lambda s: CASE WHEN s.b IN ({nuclei}) AND length(s.t) = 1 AND NOT (s.o = 'g' AND starts_with(s.b, 'i')) "
        f"THEN s.o || substr(s.b, 1, s.p - 1) || substr('{_VOWELS}', strpos('{_VOWELS}', substr(s.b, s.p, 1)) + ascii(s.t) - 48, 1) "
        f"|| substr(s.b, s.p + 1, 3) || s.k ELSE s.w END"
    )
    steps = f"list_transform(list_transform(list_transform({words_sql(expr)}, {split}), {analyse}), {rebuild})"
    return f"array_to_string({steps}, ' ')"


# vowels of the documents rewritten so that many words become Vietnamese syllables with a misplaced mark
VIET = "translate(lower(text), 'éèêçñ', 'áàươá')"


@query("tone_rules", f"SELECT doc_id, {tone_sql(VIET)} AS text FROM documents")
def tone_rules(spark, d):
    text = F.translate(F.lower("text"), "éèêçñ", "áàươá")
    return _docs(spark, d).select("doc_id", tx.normalize_tone(text).alias("text"))


def _chain_a_sql(expr: str) -> str:
    toned = tone_sql(f"nfc_normalize({clean_sql(f'lower({expr})')})")
    return f"array_to_string(list_filter(string_split({toned}, ' '), lambda w: w NOT IN ({STOP_SQL}) AND w <> ''), ' ')"


@query("clean_chain_a", f"SELECT doc_id, {_chain_a_sql(DECOMPOSED)} AS text FROM documents")
def clean_chain_a(spark, d):
    """Cleaning before composition: the marks of decomposed letters are lost, as in the first of the two chains."""
    docs = _docs(spark, d).withColumn("text", _decomposed())
    return jobs.clean_before_composing(docs, "text", STOP)


@query("clean_chain_b", f"SELECT doc_id, {clean_sql(tone_sql(f'nfc_normalize(lower({DECOMPOSED}))'))} AS text FROM documents")
def clean_chain_b(spark, d):
    """Composition first: accents survive. Without a lexicon no words are joined."""
    docs = _docs(spark, d).withColumn("text", _decomposed())
    return jobs.clean_articles(docs, "text", "doc_id")


PAIRS_SQL = f"""t AS MATERIALIZED (SELECT {words_sql("lower(text)")} AS w FROM documents),
  u AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY word HAVING count(*) >= 5),
  b AS MATERIALIZED (SELECT w1, w2, count(*) AS n_pair FROM (
    SELECT x[1] AS w1, x[2] AS w2 FROM (SELECT unnest(list_zip(w, w[2:], true)) AS x FROM t)) GROUP BY w1, w2 HAVING count(*) >= 5),
  z AS MATERIALIZED (SELECT sum(len(w)) AS words, sum(greatest(len(w) - 1, 0)) AS pairs FROM t),
  c AS MATERIALIZED (SELECT b.w1, b.w2, n_pair, a.n AS n1, e.n AS n2,
      ln((n_pair / pairs) / ((a.n / words) * (e.n / words))) / -ln(n_pair / pairs) AS npmi
    FROM b JOIN u a ON a.word = b.w1 JOIN u e ON e.word = b.w2, z)"""


def _lexicon(spark, d):
    lowered = _docs(spark, d).withColumn("text", F.lower("text"))
    return lx.collocations(lowered, "text", 5)


@query("collocations_npmi", f"WITH {PAIRS_SQL} SELECT w1, w2, n_pair, n1, n2, round(npmi, 6) AS npmi FROM c")
def collocations_npmi(spark, d):
    return _lexicon(spark, d).withColumn("npmi", F.round("npmi", 6))


def _segmented_sql(words: str) -> str:
    """The walk in SQL: one digit per word pair, leftmost non-overlapping joins, words glued by them."""
    return f"""WITH {PAIRS_SQL}, x AS (SELECT doc_id, {words} AS w FROM documents),
      p AS (SELECT doc_id, y[1] AS i, y[2] AS a, y[3] AS b
        FROM (SELECT doc_id, unnest(list_zip(range(1, len(w)), w, w[2:], true)) AS y FROM x)),
      f AS (SELECT doc_id, string_agg(CASE WHEN c.w1 IS NULL THEN '0' ELSE '1' END, '' ORDER BY i) AS f
        FROM p LEFT JOIN c ON c.w1 = a AND c.w2 = b AND npmi >= 0.3 GROUP BY doc_id),
      m AS (SELECT doc_id, w, regexp_replace(coalesce(f, '') || '0', '1[01]', '12', 'g') AS m FROM x LEFT JOIN f USING (doc_id)),
      g AS (SELECT doc_id, rtrim(array_to_string(list_transform(range(1, len(w) + 1),
        lambda i: w[i] || CASE WHEN m[i] = '1' THEN '_' ELSE ' ' END), '')) AS text FROM m)"""


@query("segment_words", f"{_segmented_sql(words_sql('lower(text)'))} SELECT doc_id, text FROM g")
def segment_words(spark, d):
    """Words joined by the lexicon of the corpus itself."""
    docs = _docs(spark, d).withColumn("text", F.lower("text"))
    return lx.segment_words(docs, "text", "doc_id", _lexicon(spark, d).where("npmi >= 0.3"))


TONED_WORDS = f"string_split({tone_sql('nfc_normalize(lower(text))')}, ' ')"


@query("clean_chain_segmented", f"{_segmented_sql(TONED_WORDS)} SELECT doc_id, {clean_sql('text')} AS text FROM g")
def clean_chain_segmented(spark, d):
    lexicon = _lexicon(spark, d).where("npmi >= 0.3")
    return jobs.clean_articles(_docs(spark, d), "text", "doc_id", lexicon)


_OPTIONS = [f"a.b{k} + x.s{k}" for k in (1, 2, 3, 4)]
_BEST = f"greatest({', '.join(_OPTIONS)})"
_PATH = " ".join(f"WHEN {_OPTIONS[k - 1]} = {_BEST} THEN a.t{k} || ' ' || x.g{k}" for k in (4, 3, 2, 1))
_FIELDS = "s1 := {0}s1, s2 := {0}s2, s3 := {0}s3, s4 := {0}s4, g1 := {0}g1, g2 := {0}g2, g3 := {0}g3, g4 := {0}g4"
_OF_SIZE = ", ".join(f"max(CASE WHEN k = {k} THEN weight END) AS s{k}, max(CASE WHEN k = {k} THEN replace(gram, ' ', '_') END) AS g{k}" for k in (1, 2, 3, 4))
_NO_STATE = ", ".join(f"b{k} := CAST(NULL AS BIGINT), t{k} := CAST(NULL AS VARCHAR)" for k in (1, 2, 3, 4))
#: dynamic programming along each clause: the last four sums (b) and paths (t) are the state
LATTICE = f"""l AS (SELECT doc_id, string_split(regexp_replace(lower(text), '([.!?…,;:])[\\s\\x0b]', '\\1' || chr(10), 'g'), chr(10)) AS l FROM documents),
  cs AS (SELECT doc_id, x[1] AS cl, x[2] AS c FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS x FROM l)),
  w AS MATERIALIZED (SELECT doc_id, cl, {words_sql("c")} AS w FROM cs),
  r AS MATERIALIZED (SELECT doc_id, cl, i, k, array_to_string(w[i - k + 1 : i], ' ') AS gram
    FROM (SELECT doc_id, cl, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 5) AS t(k) WHERE i >= k),
  n AS (SELECT gram, k, count(*) AS n FROM r GROUP BY ALL HAVING k = 1 OR count(*) >= 5),
  v AS MATERIALIZED (SELECT gram, k, CAST(round(ln(n / (SELECT sum(n) FROM n WHERE k = 1)) * 1e6) AS BIGINT) AS weight FROM n),
  p AS (SELECT doc_id, cl, i, {_OF_SIZE} FROM r JOIN v USING (gram, k) GROUP BY ALL),
  f AS (SELECT doc_id, cl, list(struct_pack({_FIELDS.format("")}, {_NO_STATE}) ORDER BY i) AS f FROM p GROUP BY ALL),
  e AS (SELECT doc_id, cl, list_reduce(list_concat([struct_pack({re.sub("s([0-9]) := s[0-9]", "s\\1 := CAST(NULL AS BIGINT)", re.sub("g([0-9]) := g[0-9]", "g\\1 := CAST(NULL AS VARCHAR)", _FIELDS.format("")))},
      b1 := CAST(0 AS BIGINT), t1 := CAST('' AS VARCHAR), {", ".join(f"b{k} := CAST(NULL AS BIGINT), t{k} := CAST(NULL AS VARCHAR)" for k in (2, 3, 4))})], f),
    lambda a, x: struct_pack({_FIELDS.format("x.")}, b1 := {_BEST}, t1 := CASE {_PATH} END, b2 := a.b1, t2 := a.t1, b3 := a.b2, t3 := a.t2, b4 := a.b3, t4 := a.t3)).t1 AS t FROM f)"""


@query(
    "segment_lattice",
    f"""WITH {LATTICE} SELECT doc_id, coalesce(string_agg(trim(t), ' ' ORDER BY cl), '') AS text
      FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id""",
)
def segment_lattice(spark, d):
    """Phrases of up to four words joined along the best path, by the lexicon of the corpus itself."""
    docs = _docs(spark, d).withColumn("text", F.lower("text"))
    return lt.segment_lattice(docs, "text", "doc_id", lt.phrases(docs, "text"))


_TYPE = r"lower(regexp_replace({0}, '\.$', ''))"
_LL = "({k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"
_CLIP = "least(greatest({0}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"
MARKS = rf"""t AS MATERIALIZED (SELECT doc_id, {words_sql("text")} AS w FROM documents),
  k AS MATERIALIZED (SELECT doc_id, x[1] AS pos, x[2] AS token, x[3] AS next FROM (SELECT doc_id, unnest(list_zip(range(len(w)), w, list_concat(w[2:], [NULL]))) AS x FROM t)),
  y AS MATERIALIZED (SELECT {_TYPE.format("token")} AS type, CAST(count(*) FILTER (ends_with(token, '.')) AS BIGINT) AS n_dot, CAST(count(*) FILTER (NOT ends_with(token, '.')) AS BIGINT) AS n_plain
    FROM k WHERE regexp_matches(token, '^\p{{L}}(?:[\p{{L}}.]*\p{{L}})?\.?$') GROUP BY ALL),
  z AS MATERIALIZED (SELECT CAST(sum(n_dot + n_plain) AS DOUBLE) AS n_all, CAST(sum(n_dot) AS DOUBLE) AS n_dots FROM y),
  a AS MATERIALIZED (SELECT y.*, n_all, round(CASE WHEN n_dot > 0 THEN
      -2 * ({_LL.format(k="n_dot", n="(n_dot + n_plain)", p=_CLIP.format("n_dots / n_all"))} - {_LL.format(k="n_dot", n="(n_dot + n_plain)", p="0.99::DOUBLE")})
      * exp(-letters) * (length(type) - letters + 1) * pow(letters, -n_plain) ELSE 0 END, 6) AS score
    FROM (SELECT *, CAST(length(replace(type, '.', '')) AS DOUBLE) AS letters FROM y) y, z),
  g AS MATERIALIZED (SELECT {_TYPE.format("next")} AS type, CAST(count(*) AS DOUBLE) AS n_start FROM k
    WHERE regexp_matches(token, '[.!?…]$') AND regexp_matches(next, '^\p{{L}}') AND {_TYPE.format("token")} NOT IN (SELECT type FROM a WHERE score >= 0.3) GROUP BY ALL),
  h AS MATERIALIZED (SELECT a.type, n_dot, n_plain, score, score >= 0.3 AS is_abbreviation, coalesce(n_start, 0) AS n_start, n_all, CAST(n_dot + n_plain AS DOUBLE) AS n,
      (SELECT sum(n_start) FROM g) AS n_ends FROM a LEFT JOIN g USING (type)),
  i AS (SELECT *, n_all - n_ends AS rest, greatest(n - n_start, 0) AS inner_n, {_CLIP.format("n / n_all")} AS p, {_CLIP.format("n_start / n_ends")} AS p1, {_CLIP.format("greatest(n - n_start, 0) / (n_all - n_ends)")} AS p2 FROM h),
  m AS MATERIALIZED (SELECT *, round(CASE WHEN n_start > 0 THEN 2 * ({_LL.format(k="n_start", n="n_ends", p="p1")} + {_LL.format(k="inner_n", n="rest", p="p2")}
      - {_LL.format(k="n_start", n="n_ends", p="p")} - {_LL.format(k="inner_n", n="rest", p="p")}) ELSE 0 END, 4) AS start_score FROM i),
  marks AS MATERIALIZED (SELECT type, n_dot, n_plain, score, is_abbreviation, CAST(n_start AS BIGINT) AS n_start, start_score, start_score >= 30 AND p1 > p AS is_starter FROM m)"""


@query("sentence_marks", f"WITH {MARKS} SELECT * REPLACE (score + 0::DOUBLE AS score, start_score + 0::DOUBLE AS start_score) FROM marks")
def sentence_marks(spark, d):
    """Abbreviations and sentence starters learned from the corpus, with their counts."""
    marks = se.learn_marks(_docs(spark, d), "text")
    return marks.select(
        "type", "n_dot", "n_plain", (F.col("score") + F.lit(0.0)).alias("score"), "is_abbreviation", "n_start",
        (F.col("start_score") + F.lit(0.0)).alias("start_score"), "is_starter",
    )


@query(
    "split_sentences",
    rf"""WITH {MARKS}, s AS (SELECT doc_id, list(pos + 1 ORDER BY pos) AS cuts FROM k LEFT JOIN marks b ON b.type = {_TYPE.format("token")} AND b.is_abbreviation
        LEFT JOIN marks c ON c.type = {_TYPE.format("next")} AND c.is_starter
      WHERE regexp_matches(token, '[.!?…]$') AND next IS NOT NULL
        AND (b.type IS NULL OR NOT ends_with(token, '.') OR (c.type IS NOT NULL AND regexp_matches(next, '^\p{{Lu}}'))) GROUP BY doc_id)
      SELECT doc_id, CAST(CASE WHEN len(w) > 0 THEN coalesce(len(cuts), 0) + 1 ELSE 0 END AS INTEGER) AS n,
        CASE WHEN len(w) > 0 THEN array_to_string(w[1 : coalesce(cuts[1], len(w))], ' ') END AS first,
        CASE WHEN len(w) > 0 THEN array_to_string(w[coalesce(cuts[-1], 0) + 1 :], ' ') END AS last
      FROM t LEFT JOIN s USING (doc_id)""",
)
def split_sentences(spark, d):
    docs = _docs(spark, d)
    found = se.split_sentences(docs, "text", "doc_id", se.learn_marks(docs, "text"))
    s = F.col("sentences")
    return found.select("doc_id", F.size(s).alias("n"), F.get(s, F.lit(0)).alias("first"), F.get(s, F.size(s) - 1).alias("last"))


@query(
    "first_sentence",
    rf"SELECT doc_id, regexp_extract(text, '(?s)^(.*?[.!?…])[\s\x0b]', 1) AS found FROM documents",
)
def first_sentence(spark, d):
    first = tx.first_sentence(F.col("text"))
    whole = first == F.col("text")
    return _docs(spark, d).select("doc_id", F.when(whole, F.lit("")).otherwise(first).alias("found"))


# --- pages -----------------------------------------------------------------------------------------------------------

_TAGS = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!DOCTYPE[^>]*>|<[^>]*>"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''")]


def _plain_sql(expr: str) -> str:
    for entity, char in _ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char}')"
    # some pages cut a heading in the middle of an entity; an ampersand needs no semicolon in HTML
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


def _first_sql(open_tag: str, tag: str) -> str:
    inner = f"regexp_extract(html, '(?s){open_tag}(.*?)</{tag}>', 1)"
    return squeeze_sql(_plain_sql(f"regexp_replace({inner}, '<[^>]*>', ' ', 'g')"))


PAGE_TEXT = _plain_sql(f"regexp_replace(html, '{_TAGS}', '', 'g')")


@query("html_text", f"SELECT page_id, {PAGE_TEXT} AS text, CAST(NULL AS VARCHAR) AS error FROM pages")
def html_text(spark, d):
    return ex.html_text(row_work(spark, d, "pages").select("page_id", "html"), "html")


@query("html_first", f"SELECT page_id, {_first_sql('<h1>', 'h1')} AS description, CAST(NULL AS VARCHAR) AS error FROM pages")
def html_first(spark, d):
    return ex.html_first(row_work(spark, d, "pages").select("page_id", "html"), "html", ("h1", None, None))


@query(
    "page_elements",
    """WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS html,
      generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) - 1 AS place FROM pages)
    SELECT page_id, CAST(place AS INTEGER) AS place, """
    + squeeze_sql(_plain_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')"))
    + " AS text FROM e",
)
def page_elements(spark, d):
    """All list elements of all pages, by a lateral join with a table function."""
    ex.register_table_functions(spark)
    pages = row_work(spark, d, "pages").select("page_id", "html")
    return spark.sql(
        "SELECT p.page_id, e.place, e.text FROM {pages} p, LATERAL page_elements(p.html, 'li') e", pages=pages
    )


@query("html_first_attr", f"""SELECT page_id, {_first_sql('<div class="ad">', 'div')} AS description, CAST(NULL AS VARCHAR) AS error FROM pages""")
def html_first_attr(spark, d):
    rows = row_work(spark, d, "pages").select("page_id", "html")
    return ex.html_first(rows, "html", ("div", "class", "ad"))


@query("html_first_missing", "SELECT page_id, '' AS description, CAST(NULL AS VARCHAR) AS error FROM pages")
def html_first_missing(spark, d):
    """The pages hold no such paragraph: every description is empty text."""
    return ex.html_first(row_work(spark, d, "pages").select("page_id", "html"), "html")


@query("clean_html", f"SELECT page_id, {_chain_a_sql(PAGE_TEXT)} AS text FROM pages")
def clean_html(spark, d):
    return jobs.clean_html(row_work(spark, d, "pages").select("page_id", "html"), "html", STOP)


def _links(spark, d):
    """Articles with links: every page under its URL, with the title from the URL's last part as text."""
    return table(spark, d, "pages").select(F.col("url").alias("link"), F.col("page_id").alias("label"))


ENRICHED = _first_sql("<h1>", "h1")


@query(
    "enrich_resume",
    f"""SELECT url AS link, page_id AS label, {ENRICHED} AS description, CAST(NULL AS VARCHAR) AS error FROM pages
    WHERE contains(url, 'example') AND NOT contains(url, 'example.org')""",
)
def enrich_resume(spark, d):
    """The links of one site are done already; the others are enriched from their pages."""
    links, pages = _links(spark, d), spread(read_pages(spark, f"{d}/pages.parquet"))
    done = links.where(F.col("link").contains("example.org"))
    return ex.enrich_from_pages(links, pages, done, "example", target=("h1", None, None))


MAX_BATCHES = 8
STREAM_SQL = f"SELECT url AS link, page_id AS label, {ENRICHED} AS description, CAST(NULL AS VARCHAR) AS error FROM pages WHERE contains(url, 'example')"


def _stream(spark, d, **form):
    pages = table(spark, d, "pages")
    # every batch looks through all pages once, so the number of batches must not grow with the table
    files = -(-len(pages.inputFiles()) // MAX_BATCHES)
    source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", max(1, files))
    # a pattern, because a stream refuses the plain path of a file; it finds a folder of files as well
    articles_ = source.parquet(f"{d}/pages.parque[t]").select(F.col("url").alias("link"), F.col("page_id").alias("label"))
    out = scratch_path(spark, "stream")
    run = stream_enrich(
        articles_, pages, out, scratch_path(spark, "stream-checkpoint"), "example", ("h1", None, None), **form
    )
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query("stream_enrich", STREAM_SQL)
def stream_enrich_query(spark, d):
    """The same as a stream over the page files, run to completion, then read from its output."""
    return _stream(spark, d)


@query("stream_enrich_state", STREAM_SQL)
def stream_enrich_state(spark, d):
    """The stream with its done links as a state by link."""
    return _stream(spark, d, keyed_state=True)
