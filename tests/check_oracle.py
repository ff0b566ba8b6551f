"""Run registered queries against their SQL in DuckDB: python tests/check_oracle.py [sf_dir] [key ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, key, query, sql):
    frame = query(spark, sf_dir)
    mine, my_names = table_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"rows={len(mine)} (no SQL)", len(mine) > 0
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs, their_names = table_of(names, result.fetchall())
    if my_names != their_names:
        return f"columns {my_names} != {their_names}", False
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:3]
        missing = [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} rows != {len(theirs)}; only ours {extra}; only SQL {missing}", False
    return f"rows={len(mine)}", True


def main(argv):
    import __spark_entry__ as entry
    from eventmart.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in argv[1:] or queries:
        start = time.time()
        try:
            text, good = compare(spark, con, sf_dir, key, queries[key], sqls.get(key))
        except Exception as error:  # report and go on with the next query
            text, good = f"{type(error).__name__}: {str(error)[:600]}", False
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {key} {time.time() - start:.1f}s {text}", flush=True)
    print("failures:", bad, "of", len(argv[1:] or queries))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
