"""Run registered queries on Spark and on DuckDB and compare rows as multisets.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SPARK_TYPES = {
    "tinyint": "TINYINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def text(value) -> str:
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(text(row[i]) for i in order) for row in rows)


def compare(con, entry, spark, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = entry.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if entry.sql is None:
        return None if got else "no rows"
    result = con.execute(entry.sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    wanted = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    clash = [(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema if SPARK_TYPES.get(f.dataType.simpleString()) != types[f.name]]
    if clash:
        return f"types {clash}"
    if not got:
        return "no rows"
    if got != wanted:
        extra, lost = got - wanted, wanted - got
        return f"{sum(extra.values())} extra of {sum(got.values())}, e.g. {list(extra)[:2]}; {sum(lost.values())} missing of {sum(wanted.values())}, e.g. {list(lost)[:2]}"
    return None


def main(argv) -> int:
    from clickloom.plans.queries import REGISTRY
    from clickloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    spark, con = local_session(), oracle(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(con, REGISTRY[name], spark, sf_dir)
        except Exception as error:  # noqa: BLE001 - reported, and the next query still runs
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
