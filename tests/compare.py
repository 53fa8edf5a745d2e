"""python tests/compare.py [--sf DIR] NAME...: runs queries beside their SQL in DuckDB and compares the rows."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(str, map(canon, v))) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(str(canon(x)) for x in v.values()) + "}"
    if hasattr(v, "tobytes"):
        return str(v.tolist())
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    began = time.time()
    df = query(spark, sf)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if not sql:
        return f"rows only {len(got)} {took:.1f}s", True
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != want_cols:
        return f"COLUMNS {cols} {want_cols}", False
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"DIFFERS {len(got)} {len(want)} {diff}", False
    return f"same {len(got)} {took:.1f}s", True


if __name__ == "__main__":
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    names = args or list(entry.queries())
    spark, sql = session(), entry.oracle_sql()
    bad = []
    for n in names:
        try:
            said, ok = compare(spark, n, entry.queries()[n], sql.get(n), sf)
        except Exception as e:  # shown, then the next
            said, ok = f"ERROR {type(e).__name__} {str(e)[:1500]}", False
        if not ok:
            bad.append(n)
        print(n, said[:1800], flush=True)
    print("bad:", bad)
