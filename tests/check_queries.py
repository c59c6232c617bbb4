"""Compare registered queries with their SQL in DuckDB: ``python tests/check_queries.py [folder] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 9)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark, con, folder: str, name: str, job, sql: str | None) -> str | None:
    """None when equal, else what differs."""
    got = job(spark, folder)
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return None if mine else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(columns)}"
    if not mine:
        return "no rows"
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:3]
        missing = [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} rows vs {len(theirs)}; only here {extra}; only there {missing}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from atlasrun.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, jobs = duck(folder), oracle_sql(), queries()
    bad = 0
    for name in args[1:] or jobs:
        began = time.time()
        try:
            problem = compare(spark, con, folder, name, jobs[name], checks.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql" if name in checks else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - began:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
