"""Run a registered query and its SQL twin over the same files and compare the rows."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v) if isinstance(v, int) else v


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark frame and a DuckDB result; empty when they agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    out = []
    order = sorted(names)
    a = Counter(tuple(plain(r[df.columns.index(n)]) for n in order) for r in ours)
    b = Counter(tuple(plain(r[names.index(n)]) for n in order) for r in theirs)
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows vs {len(theirs)}")
    if a != b:
        out.append(f"columns: {order}")
        out += [f"only here: {r}" for r in list((a - b).items())[:3]]
        out += [f"only sql: {r}" for r in list((b - a).items())[:3]]
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    for f in df.schema.fields:
        s, d = f.dataType.simpleString(), types[f.name]
        same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE"}
        if s in same and d != same[s]:
            out.append(f"type of {f.name}: {s} vs {d}")
    return out
