"""Run a registered query and its oracle side by side.

    python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, function, sql: str, folder: str) -> str | None:
    """None when both agree, else what differs."""
    df = function(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return "the plan pairs all rows"
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = _rows(df.columns, ours), _rows(names, theirs)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}; ours {left[:2]} theirs {right[:2]}"
    for x, y in zip(left, right):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"first difference: ours {x} theirs {y}"
    return None if left else "no rows"


def main() -> None:
    from evalgrain.session import build_session

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1].rstrip("/"), sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, function, oracles[name], folder)
            else:
                problem = None if function(spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
