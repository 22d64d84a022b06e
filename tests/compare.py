"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

`python tests/compare.py [folder] [query ...]` prints a line per query.
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(table) -> tuple[list[str], Counter]:
    """Column names in order and a multiset of rows."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, Counter(zip(*columns)) if columns else Counter()


KINDS = {"timestamp[us]": "timestamp", "string": "text", "large_string": "text"}


def types_of(table) -> dict[str, str]:
    return {f.name: KINDS.get(str(f.type), str(f.type)) for f in table.schema}


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Row count on Spark and what differs, None if nothing does."""
    ours = df.toArrow()
    theirs = con.sql(sql).to_arrow_table()
    a, b = types_of(ours), types_of(theirs)
    if a != b:
        return ours.num_rows, f"types {sorted(set(a.items()) ^ set(b.items()))}"
    _, left = rows_of(ours)
    _, right = rows_of(theirs)
    if left != right:
        only_left, only_right = left - right, right - left
        return ours.num_rows, (
            f"rows {ours.num_rows}/{theirs.num_rows}, only Spark {sum(only_left.values())} e.g. "
            f"{next(iter(only_left), None)}, only SQL {sum(only_right.values())} e.g. "
            f"{next(iter(only_right), None)}"
        )
    return ours.num_rows, None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            count, wrong = difference(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])
        except Exception as e:  # noqa: BLE001 - reported per query
            count, wrong = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += wrong is not None
        print(f"{name:32} {count:8} rows {time.time() - start:6.1f} s  {wrong or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
