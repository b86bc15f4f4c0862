"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
row count, column names and an order-insensitive value digest.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "int": "INTEGER", "date": "DATE", "binary": "BLOB"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def digest(rows) -> str:
    h = hashlib.sha256()
    for r in sorted("\x1f".join(_cell(v) for v in r) for r in rows):
        h.update(r.encode("utf-8", "surrogatepass"))
        h.update(b"\n")
    return h.hexdigest()


def compare(spark, con, name: str, sf_dir: str) -> dict:
    import __spark_entry__ as E
    qfn = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = [tuple(r[c] for c in s_cols) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    res["duck_rows"] = len(d_rows_raw)
    if sorted(d_cols) != s_cols:
        res["status"] = f"COLUMNS spark={s_cols} duck={sorted(d_cols)}"
        return res
    if s_types != d_types:
        res["status"] = f"TYPES spark={s_types} duck={d_types}"
        return res
    d_rows = [tuple(r[idx[c]] for c in s_cols) for r in d_rows_raw]
    ok = len(d_rows) == len(s_rows) and digest(d_rows) == digest(s_rows)
    res["status"] = "match" if ok else "MISMATCH"
    if not ok:
        sset = {tuple(_cell(v) for v in r) for r in s_rows}
        dset = {tuple(_cell(v) for v in r) for r in d_rows}
        res["only_spark"] = [r for r in list(sset - dset)[:3]]
        res["only_duck"] = [r for r in list(dset - sset)[:3]]
        res["cols"] = s_cols
    return res


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from parley.session import local_session
    import __spark_entry__ as E
    spark = local_session()
    con = duck(sf_dir)
    names = names or list(E.queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as exc:  # report and continue
            r = {"name": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:600]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
