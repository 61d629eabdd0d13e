"""Compare registered queries with their SQL twins on DuckDB.

    python -m tests.oracle [--sf 0.001] [name-substring ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "binary": "BLOB",
}


def duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return duck_type(spark_type[6:-1]) + "[]"
    return SPARK_TO_DUCK.get(spark_type, spark_type)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and its twin; empty when equal."""
    rel = con.sql(sql)
    names, types = list(rel.columns), [str(t) for t in rel.types]
    expected = con.execute(sql).fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, kind in zip(names, types):
        mine = duck_type(df.schema[name].dataType.simpleString())
        if mine != kind:
            problems.append(f"type of {name}: {mine} vs {kind}")
    order = sorted(names)
    got = [tuple(row) for row in df.select(*order).collect()]
    index = [names.index(n) for n in order]
    a = sorted("|".join(canonical(v) for v in row) for row in got)
    b = sorted("|".join(canonical(row[i]) for i in index) for row in expected)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        problems.append(f"values {order}: spark {only_a} duck {only_b}")
    if not a:
        problems.append("empty result")
    return problems


def main() -> None:
    from sparcel.plans import load_all
    from sparcel.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, q in load_all().items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf_dir)
            if q.sql is None:
                rows = df.count()
                problems = [] if rows else ["empty result"]
                note = f"rows only ({rows})"
            else:
                problems = compare(df, con, q.sql)
                note = ""
        except Exception as e:  # report and go on with the next query
            problems, note = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        took = time.time() - t0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {took:6.2f}s {name} {note}", *problems, sep="\n      ", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
