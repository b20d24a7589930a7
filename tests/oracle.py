"""Run a query on Spark and its SQL counterpart on DuckDB, and compare the two results as bags of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "int", "integer", "smallint", "tinyint", "hugeint"):
        return {"integer": "int"}.get(t, t)
    return {"varchar": "string", "float": "float", "real": "float"}.get(t, t)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between both results; an empty list means they agree."""
    names = sorted(spark_df.columns)
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    rows = res.fetchall()
    problems, kinds = [], {}
    if sorted(cols) != names:
        return [f"columns {names} != {sorted(cols)}"]
    for name, kind in con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall():
        kinds[name] = _kind(kind)
    for name, kind in spark_df.dtypes:
        if _kind(kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    at = [cols.index(n) for n in names]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in rows)
    got = Counter(tuple(_norm(r[n]) for n in names) for r in spark_df.collect())
    if got != want:
        extra, missing = list((got - want).elements()), list((want - got).elements())
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; only spark {str(extra[:3])[:400]}; only sql {str(missing[:3])[:400]}"
        )
    return problems
