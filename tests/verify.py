"""Compare queries with their SQL: python tests/verify.py [folder] [name or prefix ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])


def norm(v):  # noqa: ANN001, ANN201
    if v is None:
        return ("", None)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return ("list", tuple(norm(x) for x in v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return ("num", "nan" if math.isnan(f) else float(f"{f:.9g}"))
    return (type(v).__name__, str(v))


def rows_of(columns: list[str], rows) -> list:  # noqa: ANN001
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.execute(f"create view {name} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def compare(spark, folder: str, name: str, con=None) -> str:  # noqa: ANN001
    import __spark_entry__ as e

    df = e.queries()[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)}"
    rel = (con or oracle(folder)).execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"DIFFERENT columns {sorted(df.columns)} {sorted(cols)}"
    if got == want:
        return f"ok {len(got)}"
    a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"DIFFERENT {len(got)} {len(want)} spark: {a} sql: {b}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from graphloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(folder)
    for name in e.queries():
        if len(sys.argv) < 3 or any(name.startswith(x) for x in sys.argv[2:]):
            t = time.time()
            try:
                said = compare(spark, folder, name, con)
            except Exception as x:
                said = f"FAILED {str(x)[:600]}"
            print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
