"""Compare registered queries with their SQL, strictly.

    python tools/check_oracle.py /root/testdata/sf0.01 [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyweave.catalog.oracle import ORACLE  # noqa: E402
from tallyweave.catalog.queries import QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(df):
    df = df[sorted(df.columns)]
    rows = [tuple(map(repr_value, r)) for r in df.itertuples(index=False, name=None)]
    return sorted(rows)


def repr_value(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float) and v == 0:
        return "0.0"
    return f"{type(v).__name__}:{v!r}"


def main(folder, names):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        try:
            start = time.time()
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name:24s} {len(got):7d} {took:6.2f}s")
                continue
            start = time.time()
            want = con.sql(ORACLE[name]).df()
            sql_took = time.time() - start
            if sorted(got.columns) != sorted(want.columns):
                bad += 1
                print(f"COLS  {name:24s} {sorted(got.columns)} {sorted(want.columns)}")
                continue
            a, b = rows_of(got), rows_of(want)
            kinds = [
                c for c in got.columns if str(got[c].dtype) != str(want[c].dtype)
            ]
            if a == b:
                print(f"ok    {name:24s} {len(a):7d} {took:6.2f}s sql {sql_took:5.2f}s {kinds or ''}")
                continue
            bad += 1
            only_a = sorted(set(a) - set(b))[:2]
            only_b = sorted(set(b) - set(a))[:2]
            print(f"DIFF  {name:24s} {len(a)} {len(b)} {kinds} cols {sorted(got.columns)}")
            print("      spark", str(only_a)[:700])
            print("      sql  ", str(only_b)[:700])
        except Exception as error:
            bad += 1
            print(f"FAIL  {name:24s} {str(error).split('JVM stacktrace')[0][:500]!r}")
        sys.stdout.flush()
    print("bad", bad, "without SQL", sorted(set(QUERIES) - set(ORACLE)), set(ORACLE) - set(QUERIES))


main(sys.argv[1], sys.argv[2:] or list(QUERIES))
