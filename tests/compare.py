"""Compares queries with their SQL: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def plain(x: object) -> object:
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def differences(query, sql: str, spark, con, folder: str) -> tuple[int, list, list]:
    """The number of Spark's rows, and what only Spark or only the SQL gives."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).toLocalIterator())
    got = con.execute(f"SELECT {', '.join(cols)} FROM ({sql}) AS t")
    theirs = Counter(tuple(plain(v) for v in r) for r in got.fetchall())
    return sum(mine.values()), list((mine - theirs).items()), list((theirs - mine).items())


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    from siftline.session import get_spark

    spark = get_spark(master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = views(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name not in sqls:
                print(f"{name}: {query(spark, folder).count()} rows, no SQL, {time.time() - t:.1f} s", flush=True)
                continue
            n, a, b = differences(query, sqls[name], spark, con, folder)
            print(f"{name}: {n} rows, {'equal' if not a and not b else f'DIFFERENT {len(a)} {len(b)} {a[:3]} {b[:3]}'}, {time.time() - t:.1f} s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: FAILED {str(e)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
