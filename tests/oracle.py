"""Compare a Spark result with DuckDB SQL over the same parquet files, as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql, limit=3):
    """Empty list when equal, else a few readable differences."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    wanted = rows_of(names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if wanted == got:
        return []
    extra, missing = got - wanted, wanted - got
    return [f"{sum(got.values())} rows, expected {sum(wanted.values())}"] + [
        f"{kind}: {str(row)[:600]}" for kind, part in (("extra", extra), ("missing", missing)) for row in list(part)[:limit]
    ]
