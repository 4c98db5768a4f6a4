"""Run registered queries and their SQL side by side.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Comparable form of a cell: numbers by 9 significant digits, the rest as it is."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "NaN" if math.isnan(number) else f"{number + 0.0:.9g}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((c is not None, str(c)) for c in r))


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    result = con.execute(sql)
    return table([c[0] for c in result.description], result.fetchall())


def difference(left, right) -> str | None:
    """What differs between two tables, or None."""
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} / {len(right[1])} rows"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(argv):
    import logging

    from pyspark.sql import SparkSession

    from registry import ORACLE, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    con, bad = connect(sf_dir), []
    for name in names:
        t0 = time.time()
        try:
            left = spark_table(QUERIES[name](spark, sf_dir))
            took = time.time() - t0
            problem = difference(left, duck_table(con, ORACLE[name])) if name in ORACLE else "no SQL"
            status = f"{len(left[1])} rows" if problem is None else "DIFF " + problem
        except Exception as e:  # noqa: BLE001  (report and go on)
            took, status = time.time() - t0, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if not status[0].isdigit():
            bad.append(name)
        print(f"{name:32s} {took:6.2f}s {status}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} agree; not: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
