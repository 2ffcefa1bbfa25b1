"""Runs registered queries next to their SQL in DuckDB: python tests/check_oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def compare(spark_df, con, sql: str) -> str:
    rows = spark_df.collect()
    names = sorted(spark_df.columns)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    if sorted(columns) != names:
        return f"columns {names} vs {sorted(columns)}"
    if len(rows) != len(other):
        return f"rows {len(rows)} vs {len(other)}"
    order = [columns.index(n) for n in names]
    a = sorted(tuple(normal(r[n]) for n in names) for r in rows)
    b = sorted(tuple(normal(r[i]) for i in order) for r in other)
    if a == b:
        return "" if rows else "EMPTY"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ on {names}; first {bad[0]}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from cohortlens.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    spark = build_session("local[8]", 8, spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracle, bad = oracle_sql(), []
    for name, run in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        begun = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                message = compare(df, con, oracle[name])
            else:
                n = len(df.collect())
                message = "" if n else "EMPTY"
        except Exception as error:
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok " if not message else "BAD"
        kind = "sql" if name in oracle else "rows"
        print(f"{mark} {name} [{kind}] {time.time() - begun:.1f}s {message}", flush=True)
        if message:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
