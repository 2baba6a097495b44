"""Compare registered queries with their DuckDB statements: python tests/check_oracle.py [sf] [names…]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus=8):
    import os

    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', cpus)}]").appName("panelforge-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, bool):
            return ("b", v)
        if isinstance(v, int):
            return ("i", v)
        return ("s", repr(v)) if not hasattr(v, "as_tuple") else ("dec", str(v))
    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    got = df.collect()
    rel = con.execute(sql)
    want, names = rel.fetchall(), [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = canonical(got, df.columns), canonical(want, names)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return (f"{len(bad)} of {len(a)} differ, e.g. {bad[0]}" if bad else ""), len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, wanted = (sys.argv[1:2] or ["0.01"])[0], set(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    oracle, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem, n = compare(spark, con, folder, name, query, oracle[name])
            else:
                problem, n = "", len(query(spark, folder).collect())
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += bool(problem)
        kind = "ok " if name in oracle else "row"
        print(f"{kind if not problem else 'BAD'} {name:34s} rows={n:7d} {time.time() - start:6.2f}s {problem}", flush=True)
    print("failed:", failed)
