"""Run registered queries on both engines and compare: names, row counts, values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf: str, name: str, query, sql: str | None) -> str:
    start = time.time()
    df = query(spark, sf)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = f"{time.time() - start:.1f}s {len(got[1])} rows"
    if sql is None:
        return f"rows-only {took}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return f"ok {took}"
    a, b = set(got[1]), set(want[1])
    return (f"DIFFER spark {len(got[1])} duckdb {len(want[1])} rows\n   only spark {sorted(a - b, key=repr)[:3]}"
            f"\n   only duckdb {sorted(b - a, key=repr)[:3]}")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from papertrawl.session import builder

    spark = builder(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    }).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, wanted = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            print(name, compare(spark, sf, name, query, oracles.get(name)), flush=True)
        except Exception as e:  # report and go on
            print(name, "ERROR", type(e).__name__, str(e)[:900], flush=True)
