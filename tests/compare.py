"""Compares a registered query with its SQL on DuckDB, row by row."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def differences(df, con, sql: str) -> str:
    """Empty if equal, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = dict(zip(names, [str(d[1]) for d in result.description], strict=True))
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    bad = [
        f"{n}: {t} against {kinds[n]}" for n, t in df.dtypes if KINDS.get(t, t) != kinds[n].upper()
    ]
    at = [names.index(n) for n in order]
    theirs = Counter(tuple(_plain(row[i]) for i in at) for row in result.fetchall())
    ours = Counter(tuple(_plain(v) for v in row) for row in df.select(*order).collect())
    if ours != theirs:
        extra, missing = list((ours - theirs).items()), list((theirs - ours).items())
        return (
            f"rows {sum(ours.values())} against {sum(theirs.values())}; {order}; "
            f"only here {len(extra)}: {sorted(extra, key=str)[:2]}; "
            f"only there {len(missing)}: {sorted(missing, key=str)[:2]}"
        )[:1500]
    return "; ".join(bad)
