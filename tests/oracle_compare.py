"""Run a registered query in Spark and its SQL twin in DuckDB; compare results.

Mirrors the correctness gate: same column names, same row count and the same
multiset of rows (doubles compared after rounding to 6 decimals).
Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    try:
        import numpy as np
        if isinstance(v, np.integer):
            return str(int(v))
        if isinstance(v, np.floating):
            return canon(float(v))
        if isinstance(v, np.bool_):
            return str(bool(v))
    except ImportError:
        pass
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in records)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
                 "date": "DATE"}


def type_mismatches(sdf, rel) -> list:
    """Columns whose Spark type and DuckDB type differ."""
    duck_types = {d[0]: str(d[1]).upper() for d in rel.description}
    out = []
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        want = SPARK_TO_DUCK.get(st, st.upper())
        got = duck_types.get(f.name, "?")
        if want != got:
            out.append((f.name, st, got))
    return out


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    import __spark_entry__ as e
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = e.queries()[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = e.oracle_sql().get(name)
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    res["types"] = type_mismatches(sdf, rel)
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a == b:
        res["status"] = "match" if not res["types"] else "match-values-types-differ"
    else:
        sa, sb = set(a), set(b)
        only_s = sorted(sa - sb)[:3]
        only_d = sorted(sb - sa)[:3]
        res["status"] = "MISMATCH"
        res["cols"] = sorted(s_cols)
        res["only_spark"] = only_s
        res["only_oracle"] = only_d
    return res


def main(argv):
    from postrisk.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as e
    names = argv[2:] or list(e.queries())
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as ex:  # report and continue
            r = {"name": n, "status": f"ERROR {type(ex).__name__}: {str(ex)[:300]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
