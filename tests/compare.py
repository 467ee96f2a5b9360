"""Compare the registered queries with their SQL at one scale: python tests/compare.py sf_dir [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data),
                  key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf_dir, name, query, sql) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - start
    start = time.time()
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    oracle = time.time() - start
    note = f"{name}: {len(got)} rows, spark {took:.1f}s, sql {oracle:.1f}s"
    if sorted(got_columns) != sorted(want_columns):
        return False, f"{note} COLUMNS {sorted(got_columns)} / {sorted(want_columns)}"
    a, b = rows(got_columns, got), rows(want_columns, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, (f"{note} DIFFER {len(a)}/{len(b)}\n  spark: {str(only_a)[:900]}"
                       f"\n  sql:   {str(only_b)[:900]}")
    return True, note


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            if name in oracles:
                ok, note = compare(spark, con, sf_dir, name, queries[name], oracles[name])
            else:
                start = time.time()
                ok, note = True, f"{name}: {queries[name](spark, sf_dir).count()} rows, no sql"
                note += f", spark {time.time() - start:.1f}s"
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{name}: {type(error).__name__} {str(error)[:1200]}"
        bad += not ok
        print("ok  " if ok else "BAD ", note, flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
