"""Run registered queries and their SQL side by side: ``python -m tests.compare [names]``."""

import math
import os
import sys
import time

import duckdb
import pandas as pd


def frame_of(rows, columns):
    return sorted([tuple(_plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows], key=repr)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if v is pd.NaT:
        return None
    return v


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall(), [str(d[1]) for d in cur.description]


def compare(spark, name, run, sql, sf_dir):
    """None if equal, else what differs."""
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return (None, len(rows))
    names, want, types = oracle(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows)
    loose = {"string": "STRING", "bigint": "NUMBER", "int": "NUMBER", "double": "NUMBER", "timestamp_ntz": "DATETIME", "boolean": "bool", "date": "Date"}
    a, b = frame_of(rows, df.columns), frame_of(want, names)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"{len(a)} vs {len(b)} rows\n  spark {only_a}\n  sql   {only_b}", len(rows)
    kinds = dict(zip(names, types))
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if t == "timestamp"}
    return (f"types {odd}" if odd else None), len(rows)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    bad = 0
    for name, run in e.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            diff, n = compare(spark, name, run, e.oracle_sql().get(name), sf_dir)
        except Exception as x:  # noqa: BLE001
            diff, n = f"{type(x).__name__}: {str(x)[:1500]}", -1
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:28s} {n:7d} rows {time.time() - t:6.2f}s {diff or ''}", flush=True)
    print("bad:", bad)
