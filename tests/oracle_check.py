"""Compare registered queries with their SQL in DuckDB, row by row.

Run: python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    cols = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in cols) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = ordered([tuple(plain(r[i]) for i in at) for r in cur.fetchall()])
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(cols, a))} against {dict(zip(cols, b))}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-check-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sqls:
                verdict = compare(df, con, sqls[name]) or "ok"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:40s} {time.time() - start:6.1f}s  {verdict[:900]}", flush=True)


if __name__ == "__main__":
    main()
