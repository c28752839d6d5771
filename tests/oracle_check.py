"""Runs queries and their SQL side by side and compares them value by value."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between a Spark result and the SQL's; empty when all is equal."""
    found = []
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = table(names, result.fetchall())
    actual = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    for name, kind in spark_df.dtypes:
        if name in kinds and KINDS.get(kind, kind) != kinds[name]:
            found.append(f"type of {name}: {kind} against {kinds[name]}")
    if actual[0] != expected[0]:
        return [f"columns {actual[0]} against {expected[0]}"]
    if len(actual[1]) != len(expected[1]):
        found.append(f"{len(actual[1])} rows against {len(expected[1])}")
    bad = [(a, e) for a, e in zip(actual[1], expected[1]) if a != e]
    if bad:
        found.append(f"{len(bad)} rows differ, first {bad[0][0]} against {bad[0][1]}")
    return found


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name not in oracles:
                n = len(queries[name](spark, sf_dir).collect())
                print(f"{name}: rows only ({n}) {time.time() - start:.1f}s", flush=True)
                continue
            found = differences(queries[name](spark, sf_dir), con, oracles[name])
        except Exception as error:
            found = [str(error)[:500]]
            if names:
                traceback.print_exc()
        failed += bool(found)
        print(f"{name}: {'ok' if not found else 'DIFFERS ' + '; '.join(found)} {time.time() - start:.1f}s", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
