"""Run every registered query in Spark and its SQL twin in DuckDB; compare exactly.

usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query and exits non-zero on any mismatch.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402,F401

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if hasattr(v, "__int__") and not isinstance(v, (bool, str)):
        return int(v)
    return v


def key(row):
    return tuple((x is None, "" if x is None else str(type(x).__name__), "" if x is None else x) for x in row)


def compare(name, sdf, con, sql):
    scols = sdf.columns
    srows = [tuple(norm(r[c]) for c in sorted(scols)) for r in sdf.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return f"COLUMNS spark={scols} duck={dcols}"
    idx = [dcols.index(c) for c in sorted(scols)]
    drows = [tuple(norm(r[i]) for i in idx) for r in drows_raw]
    if len(srows) != len(drows):
        return f"ROWCOUNT spark={len(srows)} duck={len(drows)}"
    a = sorted(srows, key=key)
    b = sorted(drows, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diffs = [(c, p, q) for c, p, q in zip(sorted(scols), x, y) if p != q]
        return f"VALUES {len(bad)} rows differ; first: {diffs[:6]}"
    # type categories
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = dict(zip(dcols, [str(d[1]) for d in res.description]))
    m = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in scols:
        want = m.get(stypes[c], stypes[c])
        got = dtypes[c].upper()
        if want not in got and not (want == "VARCHAR" and "STRING" in got):
            return f"TYPE {c}: spark={stypes[c]} duck={dtypes[c]}"
    return None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from kartlane.session import get_session
    spark = get_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    fails = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            if name not in sqls:
                n = sdf.count()
                print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s)")
                continue
            err = compare(name, sdf, con, sqls[name])
        except Exception as e:  # noqa: BLE001
            err = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if err:
            fails += 1
            print(f"FAIL  {name}: {err}")
        else:
            print(f"OK    {name} ({time.time() - t0:.1f}s)")
    print(f"{fails} failures")
    sys.exit(1 if fails else 0)


if __name__ == "__main__":
    main()
