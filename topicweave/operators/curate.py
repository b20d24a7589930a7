"""Filters, derived columns, de-duplication and unions of article tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions.fixed_values import (
    LABEL_NAMES,
    OTHER_PUBLISHER,
    PUBLISHER_DOMAINS,
    TEXT_SEPARATOR,
    UNKNOWN_LABEL_PREFIX,
)
from topicweave.functions.text import assemble, is_blank
from topicweave.operators.bounded import counted_join, join_lookup, small_or_none
from topicweave.session import staged

MAX_DICTIONARY = 500


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")


# --- filters ---------------------------------------------------------------------------------------------------------


def from_site(df: DataFrame, link: str, domain: str, regex: bool = False) -> DataFrame:
    """Rows whose link contains ``domain``; as a pattern with ``regex`` (then a dot matches any character)."""
    c = F.col(link)
    return df.where(F.coalesce(c.rlike(domain) if regex else c.contains(domain), F.lit(False)))


def with_labels(df: DataFrame, label: str, allowed: Sequence) -> DataFrame:
    return df.where(F.col(label).isin(list(allowed)))


def from_first_match(df: DataFrame, pos: str, match: Column) -> DataFrame:
    """All rows from the first matching one onward, in position order. The start becomes a literal, so it reaches the
    scan as a pushed filter."""
    start = df.where(match).agg(F.min(pos)).first()[0]
    if start is None:
        raise ValueError("no row matches")
    return df.where(F.col(pos) >= F.lit(start))


def split_blank(df: DataFrame, col: str, out: str = "is_blank") -> DataFrame:
    """Mark missing or blank text; partition a write by the mark to get two disjoint, complete tables."""
    return df.withColumn(out, is_blank(F.col(col)))


def preview(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.orderBy(pos).limit(n)


def field_at(df: DataFrame, pos: str, i: int, col: str) -> DataFrame:
    return df.where(F.col(pos) == i).select(pos, col)


# --- derived columns -------------------------------------------------------------------------------------------------


def publisher(link: Column, domains=PUBLISHER_DOMAINS, other: str = OTHER_PUBLISHER) -> Column:
    """Name of the first domain, in dictionary order, that occurs anywhere in the link."""
    out = None
    for domain, name in domains:
        hit = link.contains(domain)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)


def publisher_from_table(
    df: DataFrame, link: str, row_id: str, domains: DataFrame, out: str = "source", other: str = OTHER_PUBLISHER
) -> DataFrame:
    """As ``publisher``, with the dictionary in a table (prio, domain, name).

    A dictionary of at most ``MAX_DICTIONARY`` rows becomes the same chain of conditions. A larger one is joined on
    short substrings: see ``publisher_by_gram``. Both give the same names. A missing or empty domain, which would fit
    every link or none, is an error.
    """
    if domains.where("domain IS NULL OR domain = ''").limit(1).count():
        raise ValueError("a domain in the dictionary is missing or empty")
    small = small_or_none(domains.select("prio", "domain", "name"), MAX_DICTIONARY)
    if small is not None:
        pairs = [(r["domain"], r["name"]) for r in sorted(small.toLocalIterator(), key=lambda r: r["prio"])]
        return df.withColumn(out, F.coalesce(publisher(F.col(link), pairs, other), F.lit(other)))
    return publisher_by_gram(df, link, row_id, domains, out, other)


def _grams(col: str, size: int) -> Column:
    """All substrings of one length; none for shorter or missing text."""
    starts = F.sequence(F.lit(1), F.length(col) - size + 1)
    cut = F.transform(starts, lambda i: F.substring(F.col(col), i, F.lit(size)))
    return F.array_distinct(F.when(F.length(col) >= size, cut))


def publisher_by_gram(
    df: DataFrame, link: str, row_id: str, domains: DataFrame, out: str = "source", other: str = OTHER_PUBLISHER
) -> DataFrame:
    """The join for dictionaries of any size.

    A domain occurs in a link only if each of its substrings does, so it can be looked up by any one of them. Each
    domain takes the one it shares with the fewest other domains: common openings such as ``www.`` never become keys,
    and few candidates are left to check.
    """
    size = domains.agg(F.min(F.length("domain"))).first()[0] or 1
    pieces = domains.select("prio", "domain", "name", F.explode(_grams("domain", size)).alias("_gram"))
    shared = pieces.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram")
    keyed = staged(pieces.join(shared, "_gram").groupBy("prio", "domain", "name").agg(rarest), "domains")
    slim = df.select(row_id, link, F.explode(_grams(link, size)).alias("_gram"))
    hits = join_lookup(slim, keyed, ["_gram"], "inner", spread=F.col(row_id)).where(F.col(link).contains(F.col("domain")))
    best = hits.groupBy(row_id).agg(F.min_by("name", "prio").alias(out))
    return df.join(best, row_id, "left").withColumn(out, F.coalesce(out, F.lit(other)))


def label_names(df: DataFrame, label: str, names: Sequence[str] = LABEL_NAMES, out: str = "label_name") -> DataFrame:
    """Name for each label code; a code beyond the list gets a fallback text."""
    dim = df.sparkSession.createDataFrame(list(enumerate(names)), f"{label} int, {out} string")
    fallback = F.concat(F.lit(UNKNOWN_LABEL_PREFIX), F.col(label).cast("string"))
    return df.join(F.broadcast(dim), label, "left").withColumn(out, F.coalesce(out, fallback))


def article_text(
    df: DataFrame, title: str = "title", content: str = "content", label: str = "label", out: str = "text"
) -> DataFrame:
    """Title, separator and content as one text, and the label as an integer. Without a content column: title only."""
    require_columns(df, [title, label])
    parts = [F.col(title)] + ([F.col(content)] if content in df.columns else [])
    return df.withColumn(out, assemble(parts, TEXT_SEPARATOR)).withColumn(label, F.col(label).cast("int"))


# --- de-duplication --------------------------------------------------------------------------------------------------


def _compare_key(col: str, digest: bool) -> Column:
    return F.sha2(F.col(col).cast("binary"), 256) if digest else F.col(col)


def keep_first(
    df: DataFrame, key: str, pos: str, split: Sequence[str] = (), digest: bool = False, columns: Sequence[str] | None = None
) -> DataFrame:
    """Keep the first row, by position, of every key within its split. Null is one key.

    The first positions come from an aggregate that combines on the map side, so a key held by a third of the rows
    costs one row per task; the survivors are then picked by position, which is unique. With ``columns`` only these
    (few, narrow) columns are kept next to split and position: they ride along in the aggregate, and there is neither
    a second scan nor a join. ``digest`` compares long texts by SHA-256 and so shuffles 64 characters in place of the
    text.
    """
    split = list(split)
    keyed = df.withColumn("_key", _compare_key(key, digest))
    if columns is not None:
        first = F.min_by(F.struct(pos, *columns), F.col(pos)).alias("_first")
        slim = keyed.select(*split, "_key", pos, *columns)
        return slim.groupBy(*split, "_key").agg(first).select(*split, "_first.*")
    firsts = keyed.groupBy(*split, "_key").agg(F.min(pos).alias(pos))
    firsts = firsts.select(*[F.col(c).alias(f"_f_{i}") for i, c in enumerate([*split, pos])])
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(f"_f_{i}")) for i, c in enumerate([*split, pos])])
    return df.join(firsts, same, "left_semi")


def _key_counts(df: DataFrame, key: str, split: Sequence[str], digest: bool) -> DataFrame:
    keyed = df.select(*split, _compare_key(key, digest).alias("_key"))
    return keyed.groupBy(*split, "_key").agg(F.count(F.lit(1)).alias("n"))


def duplicate_rows(df: DataFrame, key: str, pos: str, split: Sequence[str] = (), digest: bool = False) -> DataFrame:
    """Every member of every group of equal keys, first ones included. Rows of a hot key are spread by position."""
    split = list(split)
    repeated = _key_counts(df, key, split, digest).where("n > 1")
    keyed = df.withColumn("_key", _compare_key(key, digest))
    return counted_join(keyed, repeated, [*split, "_key"], "left_semi", F.col(pos)).drop("_key")


def duplicate_summary(df: DataFrame, key: str, split: Sequence[str], digest: bool = False) -> DataFrame:
    """Per split: rows, rows in groups of equal keys, rows left after keeping the first of each."""
    counts = _key_counts(df, key, list(split), digest)
    return counts.groupBy(*split).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated_rows"),
        F.count(F.lit(1)).alias("rows_left"),
    )


# --- set operations and joins ----------------------------------------------------------------------------------------


def union_checked(parts: Sequence[DataFrame], pos: str | None = None) -> DataFrame:
    """Union of tables with identical column lists, in order. With ``pos`` the order is recorded as ``src_ord``."""
    for other in parts[1:]:
        if other.columns != parts[0].columns:
            raise ValueError(f"column lists differ: {parts[0].columns} and {other.columns}")
    if pos:
        parts = [p.withColumn("src_ord", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.union, parts)


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column one part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def label_domain(truth: DataFrame, predicted: DataFrame, out: str = "label") -> DataFrame:
    """Distinct labels over both one-column tables. Each side is reduced before the union is shuffled."""
    a, b = (d.toDF(out).where(F.col(out).isNotNull()).distinct() for d in (truth, predicted))
    return a.union(b).distinct()


def todo_rows(df: DataFrame, done: DataFrame, link: str) -> DataFrame:
    """Rows whose link is not among the finished ones. Null links stay, and skip the join: they could only pile up
    in one task."""
    links = done.select(link).where(F.col(link).isNotNull()).distinct()
    open_rows = df.where(F.col(link).isNotNull()).join(links, link, "left_anti")
    return open_rows.unionByName(df.where(F.col(link).isNull()))


def enrich(df: DataFrame, found: DataFrame, on: str, col: str, others: Sequence[str] = ()) -> DataFrame:
    """Left join with one value per key; without a match the value is empty text. ``others``: further columns of
    ``found`` to carry over, null without a match."""
    hit = df.where(F.col(on).isNotNull()).join(found.select(on, col, *others), on, "left")
    miss = df.where(F.col(on).isNull()).withColumns({c: F.lit(None).cast("string") for c in (col, *others)})
    return hit.unionByName(miss).withColumn(col, F.coalesce(col, F.lit("")))


def lookup_scores(candidates: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates with a cached score, and those still to be evaluated."""
    known = join_lookup(candidates, cache, keys, "inner")
    return known, candidates.join(cache.select(*keys).distinct(), list(keys), "left_anti")
