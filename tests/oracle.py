"""Side-by-side run of a catalogue query and its SQL."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], [str(c[1]) for c in cursor.description], cursor.fetchall()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(normal(row[i]) for i in order) for row in rows], key=repr)


def compare(spark, con, sf_dir: str, query, sql: str, check=lambda df: None) -> tuple[str, int, float, float]:
    started = time.time()
    df = query(spark, sf_dir)
    check(df)
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    spark_time = time.time() - started
    started = time.time()
    names, types, rows = sql_rows(con, sql)
    right = canonical(names, rows)
    sql_time = time.time() - started
    verdict = "equal"
    if left[0] != right[0]:
        verdict = f"columns differ: {sorted(set(left[0]) ^ set(right[0]))}"
    elif len(left[1]) != len(right[1]):
        verdict = f"rows differ: {len(left[1])} and {len(right[1])}"
    elif left[1] != right[1]:
        wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        a, b = wrong[0]
        at = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y]
        verdict = f"{len(wrong)} rows differ, first: {at[:6]} in {a[:4]}"
    else:
        kinds = dict(df.dtypes)
        loose = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER"}
        off = [(n, kinds[n], t) for n, t in zip(names, types) if loose.get(kinds[n]) != t]
        if off:
            verdict = f"equal, types differ: {off}"
    return verdict, len(left[1]), spark_time, sql_time


def main() -> None:
    import sys

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from barwright.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        try:
            verdict = compare(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql()[name])
            print(f"{name:26s} {verdict[1]:7d} rows  spark {verdict[2]:6.2f}s  sql {verdict[3]:6.2f}s  {verdict[0]}", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"{name:26s} FAILED {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
