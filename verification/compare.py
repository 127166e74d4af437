"""Run queries and their SQL side by side: ``python -m verification.compare [sf_dir] [key ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from mailquill.session import configure
from verification.oracle import ORACLES
from verification.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(record[at] for at in order) for record in records), key=repr)


SAME_TYPE = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
}


def differences(spark, connection, key: str, sf_dir: str) -> list[str]:
    """Empty when columns, types and all values agree."""
    frame = QUERIES[key](spark, sf_dir)
    found = [tuple(row) for row in frame.collect()]
    cursor = connection.execute(ORACLES[key])
    types = {column[0]: str(column[1]) for column in cursor.description}
    expected = cursor.fetchall()
    problems = []
    ours = {name: SAME_TYPE.get(kind, kind) for name, kind in frame.dtypes}
    if ours != types:
        problems.append(f"types {ours} != {types}")
    left, right = rows_of(found, frame.columns), rows_of(expected, list(types))
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)}")
    if left != right:
        here, there = set(left), set(right)
        problems.append(f"only ours {list(here - there)[:2]}"[:1500])
        problems.append(f"only sql {list(there - here)[:2]}"[:1500])
    return problems or ([] if left else ["no rows"])


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark = configure(
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for key in keys:
        began = time.time()
        try:
            problems = differences(spark, connection, key, sf_dir)
        except Exception:
            problems = [traceback.format_exc()[-1800:]]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {key} {time.time() - began:.2f}s", *problems, sep="\n     ", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
