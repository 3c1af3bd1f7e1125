"""Differential check: each registered Spark query against its DuckDB SQL.

Mirrors the driver's compare: row count, column names (sorted) and an
order-insensitive multiset of row values. Usable from pytest and as a script:

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
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
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, places: int):
    if v is None or v is getattr(__import__("pandas"), "NA", object()):
        return None
    try:
        if __import__("pandas").isna(v) is True:
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, places)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), places)
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(pdf, places: int):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x, places) for x in rec))
    out.sort(key=repr)
    return cols, out


def compare(spark, sf_dir: str, names=None, places: int = 9, verbose: bool = True) -> dict:
    import pandas as pd

    from cohort_spark.plans.catalog import QUERIES
    from cohort_spark.plans.oracle import SQL

    con = duck(sf_dir)
    report = {}
    for name in sorted(names or QUERIES):
        t0 = time.time()
        entry = {"oracle": name in SQL}
        try:
            sdf = QUERIES[name](spark, sf_dir)
            spdf = pd.DataFrame(sdf.collect(), columns=sdf.columns) if sdf.columns else pd.DataFrame()
            entry["rows"] = len(spdf)
            entry["spark_sec"] = round(time.time() - t0, 2)
            if name in SQL:
                opdf = con.execute(SQL[name]).df()
                entry["oracle_rows"] = len(opdf)
                sc, sr = rows_of(spdf, places)
                oc, orows = rows_of(opdf, places)
                entry["cols_match"] = sc == oc
                entry["rows_match"] = len(sr) == len(orows)
                entry["values_match"] = sr == orows
                if verbose and not (entry["cols_match"] and entry["values_match"]):
                    print(f"  [{name}] spark cols {sc}\n  [{name}] duck  cols {oc}")
                    a, b = set(sr), set(orows)
                    print(f"  [{name}] only spark: {sorted(a - b, key=repr)[:3]}")
                    print(f"  [{name}] only duck : {sorted(b - a, key=repr)[:3]}")
        except Exception as exc:  # report and continue
            entry["error"] = f"{type(exc).__name__}: {str(exc)[:400]}"
        report[name] = entry
        if verbose:
            print(name, entry, flush=True)
    return report


if __name__ == "__main__":
    from cohort_spark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    rep = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in rep.items() if "error" in v or (v.get("oracle") and not (v.get("cols_match") and v.get("values_match")))]
    print("FAILED:", bad)
    print(f"{len(rep) - len(bad)}/{len(rep)} ok")
