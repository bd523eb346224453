"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: ``python tests/oracle_compare.py [sf_dir] [name ...]``. Mirrors the
driver's check: row count, column names, column types, and an
order-insensitive hash of the values (columns sorted by name).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from mailsift.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def digest(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest()


_KIND = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int", "hugeint": "int",
         "double": "float", "float": "float", "decimal": "dec", "string": "str", "varchar": "str",
         "boolean": "bool"}


def kind(t: str) -> str:
    t = t.lower()
    for k, v in _KIND.items():
        if t.startswith(k):
            return v
    return t


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    t1 = time.time()
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    dtypes = {d[0]: str(d[1]) for d in rel.description}
    t2 = time.time()
    res = {"name": name, "rows": (len(srows), len(drows)), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    res["cols_ok"] = sorted(scols) == sorted(dcols)
    res["types_ok"] = res["cols_ok"] and all(kind(stypes[c]) == kind(dtypes[c]) for c in scols)
    if not res["types_ok"] and res["cols_ok"]:
        res["types"] = {c: (stypes[c], dtypes[c]) for c in scols if kind(stypes[c]) != kind(dtypes[c])}
    if not res["cols_ok"]:
        res["cols"] = (sorted(scols), sorted(dcols))
    res["values_ok"] = res["cols_ok"] and digest(scols, srows) == digest(dcols, drows)
    if res["cols_ok"] and not res["values_ok"]:
        so = sorted(range(len(scols)), key=lambda i: scols[i])
        do = sorted(range(len(dcols)), key=lambda i: dcols[i])
        a = sorted(repr(tuple(_norm(r[i]) for i in so)) for r in srows)
        b = sorted(repr(tuple(_norm(r[i]) for i in do)) for r in drows)
        sa, sb = set(a), set(b)
        res["only_spark"] = [x[:300] for x in sorted(sa - sb)[:3]]
        res["only_duck"] = [x[:300] for x in sorted(sb - sa)[:3]]
    res["ok"] = res["rows"][0] == res["rows"][1] and res["values_ok"] and res["types_ok"]
    return res


def main(argv: list[str]) -> int:
    from mailsift.plans.registry import oracle_sql, queries
    from mailsift.session import get_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name in sorted(qs):
        if names and not any(name.startswith(n) for n in names):
            continue
        if name not in os_:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS {name}: {n} rows ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            r = compare(spark, con, sf_dir, name, qs[name], os_[name])
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "error": repr(e)[:800]}
        bad += not r["ok"]
        print(("OK   " if r["ok"] else "FAIL ") + str(r), flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
