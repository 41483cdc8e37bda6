"""Compare registered queries with their SQL twins in DuckDB: python -m tests.compare [sf] [name-part ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("", "") if math.isnan(v) else ("n", v)
    if isinstance(v, int) or type(v).__name__ == "Decimal":
        return ("n", float(v))
    return ("s", str(v))


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else the first difference."""
    cols = spark_df.columns
    ours = normal(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    theirs = normal([c[0] for c in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} vs {len(theirs[1])}; first {ours[1][:1]} vs {theirs[1][:1]}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours[1])} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    return None


def main(argv: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from tidyorder.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    twins = oracle_sql()
    good = bad = 0
    for name, fn in queries().items():
        if argv[1:] and not any(p in name for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in twins:
                verdict = difference(df, con, twins[name])
            else:
                rows = df.collect()
                verdict = None
                print("   rows-only", len(rows), str(rows[:1])[:200])
        except Exception as problem:  # noqa: BLE001
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        good, bad = good + (verdict is None), bad + (verdict is not None)
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - start:.1f}s {(verdict or '')[:900]}", flush=True)
    print(f"{good} ok, {bad} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
