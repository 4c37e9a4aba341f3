"""Run registered queries next to their SQL and report differences.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    df = fn(spark, sf_dir)
    got, columns = [tuple(r) for r in df.collect()], df.columns
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(want_columns):
        return f"columns {columns} != {want_columns}"
    a, b = normal(got, columns), normal(want, want_columns)
    if a == b:
        kinds = {c: (type(x).__name__, type(y).__name__) for c, x, y in zip(sorted(columns), a[0], b[0])} if a else {}
        odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
        return f"types differ: {odd}" if odd else None
    extra = [x for x in a if x not in set(b)][:3]
    missing = [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows != {len(b)}; extra {extra}; missing {missing}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from orthant import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(
                spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir
            )
        except Exception as err:  # noqa: BLE001
            problem = f"{type(err).__name__}: {str(err)[:300]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(names)} queries, {bad} bad")
