"""Secret scan over a trigram inverted index (operator 9). DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an OR of clauses, each an AND of trigrams that
every match must contain. One pass over the texts writes the postings (trigram, row) of the trigrams that occur in any
clause; intersecting the postings of a clause gives its candidate rows; only those are read again and verified with the
regular expression. A rule without a mandatory trigram (a run of hex digits) scans every text.

The index is in lower case, so it also serves rules that ignore case; candidates are a superset and verification is
exact. Rows are named by (doc_id, text digest): repeated and null ids keep apart what differs. On the second read a
bitmap of fixed size keeps the texts of other rows out of the shuffle.

A match of a rule is leftmost and does not overlap others of its rule; a match that fails the rule's further test (the
length of its value) is dropped, and the search goes on behind it. Offsets count code points, the end is exclusive.

Null and empty texts have no spans: counts of 0, an empty span list, the digest of an empty string. Every row of the
input gives one row; repeated rows give equal rows; an empty table gives an empty result. Extra columns of the input are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import LOWER, UPPER, query, table, text_key
from topicweave.operators.bounded import maybe_in, unused
from topicweave.session import staged

MAX_ALTERNATIVES = 32


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the common subset of Python and Java; ``value``: group whose length must reach ``least``."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


#: fixed values: the base rules and three public token formats; the kinds in this order
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]

# A parsed expression as alternatives; an alternative is a list of literal runs that occur in this order, None marks a gap.
Alternatives = list[list]
GAP: Alternatives = [[None]]


def _join(left: Alternatives, right: Alternatives) -> Alternatives:
    return [[*a, *b] for a in left for b in right]


def _alternatives(tree) -> Alternatives:
    """Alternatives of a regular expression. Whatever is not a short literal becomes a gap, which only loosens the query."""
    out: Alternatives = [[]]
    for op, arg in tree:
        if op is sre.LITERAL:
            part = [[chr(arg).lower()]]
        elif op is sre.SUBPATTERN:
            part = _alternatives(arg[3])
        elif op is sre.BRANCH:
            part = [x for branch in arg[1] for x in _alternatives(branch)]
        elif op is sre.IN and len(arg) <= 8 and all(x[0] is sre.LITERAL for x in arg):
            part = [[chr(x[1]).lower()] for x in arg]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            part = [[], *_alternatives(arg[2])]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == arg[1] and arg[0] <= 8:
            part = reduce(_join, [_alternatives(arg[2])] * arg[0], [[]])
        elif op is sre.AT:
            part = [[]]
        else:
            part = GAP
        joined = _join(out, part)
        out = joined if len(joined) <= MAX_ALTERNATIVES else _join(out, GAP)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs: every match contains all trigrams of at least one clause. An empty clause means: any text."""
    clauses = set()
    for parts in _alternatives(_parser.parse(pattern)):
        runs = "".join("\0" if p is None else p for p in parts).split("\0")
        clauses.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, row key) for every trigram of ``trigrams`` that a text contains."""
    low = rows.select("_id", "_key", F.translate(F.col("_text"), UPPER, LOWER).alias("_low"))
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("_id", "_key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(kind, row key) of the rows in the intersected postings of any clause."""
    spark = index.sparkSession
    wanted = [(kind, n, t, len(c)) for kind, q in queries.items() for n, c in enumerate(q) for t in sorted(c)]
    clauses = spark.createDataFrame(wanted, "kind string, clause int, trigram string, need int")  # bounded by the rules
    hits = index.join(F.broadcast(clauses), "trigram").groupBy("_id", "_key", "kind", "clause", "need")
    met = hits.agg(F.count(F.lit(1)).alias("n")).where("n >= need")
    return met.groupBy("_id", "_key").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(rule: Rule, text: Column) -> Column:
    """Array of (start, end) of the rule's matches, by cutting the text at them and adding up lengths."""
    pattern = F.lit(rule.pattern)
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    between = lengths(F.split(text, rule.pattern, -1))
    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    value = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.value)))
    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("len"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    none = F.array().cast("array<struct<start:int,end:int,value:int>>")
    return F.when(F.regexp_like(text, pattern), F.filter(found, lambda m: m["value"] >= rule.least)).otherwise(none)


def _spans(rules: list[Rule], text: Column, order: dict[str, int], only: Column | None = None) -> Column:
    """All spans of several rules as (start, place of the kind, end, kind)."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    lists = []
    for r in rules:
        rank, kind = F.lit(order[r.kind]), F.lit(r.kind)
        found = F.transform(
            rule_spans(r, text), lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), m["end"].alias("end"), kind.alias("kind"))
        )
        lists.append(found if only is None else F.when(F.array_contains(only, r.kind), found).otherwise(empty))
    return F.concat(empty, *lists)


def scan(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the digest of the text ``text_key``, and ``found``: an array of
    (start, rank, end, kind), by start and then by the order of the rules."""
    order = {r.kind: i for i, r in enumerate(rules)}
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    full = [r for r in rules if frozenset() in queries[r.kind]]
    indexed = [r for r in rules if r not in full]
    rows = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    scanned = rows.select("_id", "_key", _spans(full, F.col("_text"), order).alias("full")) if full else rows.select("_id", "_key", F.array().alias("full"))
    if not indexed:
        return scanned.select(F.col("_id").alias(doc_id), F.col("_key").alias("text_key"), F.array_sort("full").alias("found"))
    queries = {r.kind: queries[r.kind] for r in indexed}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    index = staged(postings(rows, trigrams), "trigram-index")
    chosen = staged(candidates(index, queries), "secret-candidates")
    same = lambda a, b: a["_id"].eqNullSafe(b["_cid"]) & (a["_key"] == b["_ckey"])
    named = chosen.select(F.col("_id").alias("_cid"), F.col("_key").alias("_ckey"), "kinds")
    may = maybe_in(rows, chosen.select("_key"), "_key")
    checked = may.join(named, same(may, named))
    verified = checked.select("_id", "_key", _spans(indexed, F.col("_text"), order, F.col("kinds")).alias("more"))
    # a row that is repeated is found repeatedly; equal rows have equal spans
    more = verified.where(F.size("more") > 0).groupBy("_id", "_key").agg(F.first("more").alias("more"))
    more = more.select(F.col("_id").alias("_cid"), F.col("_key").alias("_ckey"), "more")
    both = scanned.join(more, same(scanned, more), "left")
    found = F.array_sort(F.when(F.col("more").isNull(), F.col("full")).otherwise(F.concat("full", "more")))
    return both.select(F.col("_id").alias(doc_id), F.col("_key").alias("text_key"), found.alias("found"))


def span_text(found: Column) -> Column:
    as_text = lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))
    return F.concat_ws(",", F.transform(found, as_text))


def mask(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[kind]``; ``n_chars``, if there, is counted again.

    Overlapping spans are replaced together, under the name of the first.
    """
    key, cid, ckey, spans = unused(docs.columns, "_tk", "_cid", "_ckey", "_found")
    whole = docs.withColumn(key, text_key(F.col("text")))
    hits = scan(docs, rules).where(F.size("found") > 0).select(F.col("doc_id").alias(cid), F.col("text_key").alias(ckey), F.col("found").alias(spans))
    hits = staged(hits.groupBy(cid, ckey).agg(F.first(spans).alias(spans)), "secrets-found")
    keys = hits.select(F.col(ckey).alias(key))
    keyed = maybe_in(whole, keys, key)
    joined = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits[cid]) & (keyed[key] == hits[ckey]), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, m["start"] - acc["at"])
        done = F.struct(m["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), m["kind"], F.lit("]")).alias("out"))
        overlap = F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(m["start"] >= acc["at"], done).otherwise(overlap)

    cut = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut)
    out = joined.withColumn("text", text)
    named = [F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        n = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
        out = out.withColumn("n_chars", n)
    return out.select(*named).union(maybe_in(whole, keys, key, "left_anti").select(*named))


SQL = None  # offsets of matches have no counterpart in DuckDB's functions; see tests/llm


@query("op9_secret_scan", SQL)
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda m: m["rank"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda m: m["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
    )
