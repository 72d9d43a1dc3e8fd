"""Run registered queries in Spark and their SQL in DuckDB and compare the rows exactly.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

from checks.oracles import ORACLE_SQL
from checks.queries import QUERIES
from tidemark.plans.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def mismatch(spark, con, name: str, sf_dir: str) -> str | None:
    """None where both engines agree on column names, types and rows; else what differs."""
    ours = QUERIES[name](spark, sf_dir).toArrow()
    theirs = con.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    if columns != sorted(theirs.column_names):
        return f"columns {columns} and {sorted(theirs.column_names)}"
    kinds = [(c, ours.schema.field(c).type, theirs.schema.field(c).type) for c in columns]
    differing = [k for k in kinds if k[1] != k[2] and not {str(k[1]), str(k[2])} <= _STRINGS]
    if differing:
        return f"types {differing}"
    if ours.num_rows != theirs.num_rows:
        return f"{ours.num_rows} and {theirs.num_rows} rows"
    con.register("ours", ours)
    con.register("theirs", theirs)
    listed = ", ".join(f'"{c}"' for c in columns)
    extra = con.execute(
        f"SELECT {listed} FROM ours EXCEPT ALL SELECT {listed} FROM theirs"
    ).fetchall()
    if extra:
        missing = con.execute(
            f"SELECT {listed} FROM theirs EXCEPT ALL SELECT {listed} FROM ours"
        ).fetchall()
        return f"{len(extra)} rows differ, as {extra[:2]} against {missing[:2]}"
    return None


_STRINGS = {"string", "large_string"}


def main(sf_dir: str, names: list[str]) -> int:
    spark = session(
        "compare",
        "local[8]",
        partitions=8,
        **{
            "spark.checkpoint.dir": os.environ.get("SHARED_DIR", "/tmp/tidemark-shared"),
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name in names or QUERIES:
        begun = time.time()
        try:
            problem = mismatch(spark, con, name, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{time.time() - begun:6.2f}s {name}: {problem or 'ok'}", flush=True)
    return failures


if __name__ == "__main__":
    given = sys.argv[1:]
    where = given.pop(0) if given and "/" in given[0] else "/root/testdata/sf0.01"
    sys.exit(main(where, given))
