"""Compare queries with their SQL in DuckDB, and run single queries: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p)[:-8]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def plain(x):
    import datetime
    import decimal
    import math

    import numpy as np

    if x is None:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine), None
    res = con.execute(sql)
    cols = [x[0] for x in res.description]
    theirs = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(mine), f"columns {sorted(df.columns)} != {sorted(cols)}"
    if mine != theirs:
        a, b = [x for x in mine if x not in set(theirs)][:3], [x for x in theirs if x not in set(mine)][:3]
        return len(mine), f"{len(mine)} rows against {len(theirs)}; only here {a}; only SQL {b}"
    return len(mine), ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from gyeol.session import local_session

    spark, d, con = local_session(), sys.argv[1], connect(sys.argv[1])
    q, s = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            n, why = differences(spark, con, q[name], s.get(name), d)
            print(f"{name}: {n} rows, {time.time() - t:.1f} s", "no SQL" if why is None else why and f"DIFFERS: {why}" or "equal", flush=True)
        except Exception as x:
            print(f"{name}: FAILED {type(x).__name__} {str(x)[:1500]}", flush=True)
