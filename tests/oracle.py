"""Run a query and its SQL side by side and compare names, row counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import re

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"dec:{value.normalize()}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(names, rows, ordered):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return found if ordered else sorted(found, key=lambda r: tuple((v is not None, v or "") for v in r))


def states_order(sql):
    """Whether the statement itself, not a part in brackets, says in which order its rows come."""
    while (flat := re.sub(r"\([^()]*\)", "", sql)) != sql:
        sql = flat
    return "ORDER BY" in sql.upper()


def compare(spark, con, build, sql, sf_dir):
    """None when equal, otherwise what differs."""
    df = build(spark, sf_dir)
    ordered = states_order(sql)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()], ordered)
    relation = con.sql(sql)
    names = list(relation.columns)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    theirs = rows_of(names, relation.fetchall(), ordered)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"first difference\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}"
    return None
