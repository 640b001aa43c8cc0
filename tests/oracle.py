"""Runs queries and their SQL over the same tables and compares rows, column names and types."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.12g}")) if v else "0.0"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(df, sql: str, c) -> str:
    """'' if the rows are the same, else what differs."""
    r = c.execute(sql)
    names, kinds = [d[0] for d in r.description], [str(d[1]) for d in r.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = dict(zip(names, kinds, strict=True))
    other = [f"{n}: {k} and {theirs[n]}" for n, k in df.dtypes if TYPES.get(k, k) != theirs[n]]
    order = sorted(df.columns)
    a = sorted(tuple(plain(x) for x in row) for row in df.select(*order).collect())
    at = [names.index(n) for n in order]
    b = sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; {only}" + (f"; types {other}" if other else "")
    return f"types {other}" if other else ""


if __name__ == "__main__":
    from lodegraph import registry
    from lodegraph.session import session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = session(f"local[{os.environ.get('TEST_CPUS', '8')}]", 8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), registry.oracles()
    for name, f in registry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            df = f(spark, sf_dir)
            said = compare(df, sqls[name], con) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as e:
            said = f"ERROR {str(e)[:700]}"
        print(f"{name} {time.time() - began:.1f}s {said or 'same'}", flush=True)
