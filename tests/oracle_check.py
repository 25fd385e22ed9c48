"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py [sf] [name-part ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

import __spark_entry__ as entry_module

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{root}/{n}.parquet'")
    return con


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple("NULL" if v is None or v is pd.NA or v is pd.NaT or v != v else (repr(float(v)) if isinstance(v, float) else str(v)) for v in rec))
    return cols, sorted(out)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    gc, g = rows_of(got)
    wc, w = rows_of(want)
    if gc != wc:
        return f"columns {gc} != {wc}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in gc if got[c].dtype.kind != want[c].dtype.kind}
    note = f" kinds {kinds}" if kinds and not got.isna().any().any() else ""
    if len(g) != len(w):
        return f"rows {len(g)} != {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} rows differ, e.g. {gc}\n   spark  {bad[0][0]}\n   duckdb {bad[0][1]}"
    return "ok" + note


def main(argv):
    sf = argv[0] if argv else "0.001"
    wanted = argv[1:]
    root = f"/root/testdata/sf{sf}"
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    oracle = entry_module.oracle_sql()
    good = bad = 0
    for name, fn in entry_module.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            got = fn(spark, root).toPandas()
            took = time.time() - t
            if name in oracle:
                verdict = compare(got, con.execute(oracle[name]).df())
            else:
                verdict = f"ok (rows only, {len(got)} rows)"
        except Exception as e:
            took = time.time() - t
            verdict = "ERROR " + "".join(traceback.format_exception_only(e))[:600]
        ok = verdict.startswith("ok")
        good, bad = good + ok, bad + (not ok)
        print(f"{'PASS' if ok else 'FAIL'} {name} {took:.1f}s {len(got) if ok else ''} {verdict}", flush=True)
    print(f"{good} good, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
