"""Run registered queries in Spark and their DuckDB oracle side by side and
compare row count, column names/types and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import json
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from claimtrail.plans.tables import TABLES  # noqa: E402


STRICT = False


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in sorted(v.items())}
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "FloatType": "FLOAT", "ShortType": "SMALLINT", "DateType": "DATE",
                 "TimestampType": "TIMESTAMP WITH TIME ZONE", "TimestampNTZType": "TIMESTAMP"}


def spark_types(df):
    return {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, str(f.dataType)) for f in df.schema.fields}


def duck(sf_dir, sql, with_types=False):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    cols = rel.columns
    types = {c: str(t) for c, t in zip(cols, rel.types)}
    rows = rel.fetchall()
    return (cols, rows, types) if with_types else (cols, rows)


def compare(spark, name, fn, sql, sf_dir, show=3):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(rows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    dcols, drows, dtypes = duck(sf_dir, sql, with_types=True)
    h1, l1 = digest(cols, rows)
    h2, l2 = digest(dcols, drows)
    stypes = spark_types(df)
    type_diff = {c: (stypes.get(c), dtypes.get(c)) for c in cols if stypes.get(c) != dtypes.get(c)}
    res.update(duck_rows=len(drows), cols_match=sorted(cols) == sorted(dcols),
               hash_match=h1 == h2, types_match=not type_diff)
    if type_diff:
        res["type_diff"] = type_diff
    res["status"] = "ok" if (res["cols_match"] and h1 == h2) else "MISMATCH"
    if res["status"] == "ok" and type_diff:
        res["status"] = "TYPES"
    if res["status"] != "ok":
        res["spark_cols"], res["duck_cols"] = sorted(cols), sorted(dcols)
        s1, s2 = set(l1), set(l2)
        res["only_spark"] = sorted(s1 - s2)[:show]
        res["only_duck"] = sorted(s2 - s1)[:show]
    return res


if __name__ == "__main__":
    import __spark_entry__ as E
    from claimtrail.session import local_session

    args = [a for a in sys.argv[1:] if a != "--strict"]
    STRICT = "--strict" in sys.argv
    sf = args[0] if args else "/root/testdata/sf0.01"
    only = set(args[1:])
    import os
    spark = local_session(cores=os.environ.get("CHECK_CORES", "*"),
                          shuffle_partitions=int(os.environ.get("CHECK_PARTITIONS", "8")))
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only and not any(name.startswith(o) for o in only):
            continue
        try:
            r = compare(spark, name, fn, sqls.get(name), sf)
        except Exception as exc:  # report and continue
            r = {"name": name, "status": "ERROR", "error": str(exc)[:800]}
        bad += r["status"] in ("MISMATCH", "ERROR", "TYPES")
        print(json.dumps(r, default=str), flush=True)
    print("bad", bad)
