"""Run registered queries in Spark and their SQL in DuckDB, and compare rows, names and types.

Usage: python tools/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from rosterlake.registry import REGISTRY, statement  # noqa: E402

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPE_NAMES = {
    T.LongType: "BIGINT",
    T.IntegerType: "INTEGER",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.DateType: "DATE",
    T.BooleanType: "BOOLEAN",
}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _sorted_rows(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float]:
    """('ok' or what differs, number of rows, seconds in Spark)."""
    query = REGISTRY[name]
    began = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    took = time.time() - began
    if query.sql is None:
        return "rows only", len(rows), took
    result = con.execute(statement(query.sql))
    columns = [(d[0], str(d[1])) for d in result.description]
    expected = result.fetchall()
    problems = []
    if sorted(df.columns) != sorted(c for c, _ in columns):
        return f"columns {sorted(df.columns)} / {sorted(c for c, _ in columns)}", len(rows), took
    types = {f.name: TYPE_NAMES.get(type(f.dataType), f.dataType.simpleString().upper()) for f in df.schema.fields}
    problems += [f"type of {c}: {types[c]} / {t}" for c, t in columns if types[c] != t.replace(", ", ",")]
    here, there = _sorted_rows(df.columns, rows), _sorted_rows([c for c, _ in columns], expected)
    if here != there:
        extra, missing = sorted(set(here) - set(there))[:2], sorted(set(there) - set(here))[:2]
        problems.append(f"rows {len(here)} / {len(there)}; only Spark {extra}; only SQL {missing}")
    return "; ".join(problems) or "ok", len(rows), took


def main() -> int:
    from rosterlake.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark, con = local_session("8"), oracle(sf_dir)
    bad = 0
    for name in [n for n in REGISTRY if n.startswith(prefixes)]:
        try:
            verdict, rows, took = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            verdict, rows, took = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        bad += verdict != "ok"
        print(f"{name:36s} {rows:8d} {took:6.2f}s  {verdict}", flush=True)
    print(f"{bad} not ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
