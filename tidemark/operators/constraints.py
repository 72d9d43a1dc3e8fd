"""Keys that must be unique and references that must lead somewhere: violations, counted.

Every join of this library takes catalogue names and ids to be unique; a name that comes twice doubles
all that is summed over it, without an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a report of violations: ``n`` rows break rule ``kind`` of check ``name`` with this ``key``.
REPORT = "name STRING, kind STRING, key STRING, n BIGINT"


@dataclass(frozen=True)
class Unique:
    """No two rows of ``table`` have equal ``key``; rows with a null in it break ``null``, if not ``nullable``."""

    name: str
    table: DataFrame
    key: tuple[str, ...]
    nullable: bool = False

    def violations(self) -> DataFrame:
        counted = _by_key(self.table, self.key)
        doubled = counted.where(~F.col("_null") & (F.col("n") > 1))
        report = _report(doubled, self.name, "doubled")
        return report if self.nullable else report.unionByName(_nulls(counted, self.name))


@dataclass(frozen=True)
class Reference:
    """Every non-null ``key`` of ``table`` is the ``target_key`` of a row of ``target``."""

    name: str
    table: DataFrame
    key: tuple[str, ...]
    target: DataFrame
    target_key: tuple[str, ...]
    nullable: bool = True

    def violations(self) -> DataFrame:
        counted = _by_key(self.table, self.key)
        known = self.target.select(*[F.col(f"`{t}`").alias(f"_key_{i}") for i, t in enumerate(self.target_key)])
        columns = [f"_key_{i}" for i in range(len(self.key))]
        lost = counted.where(~F.col("_null")).join(known, columns, "left_anti")
        report = _report(lost, self.name, "missing")
        return report if self.nullable else report.unionByName(_nulls(counted, self.name))


def violations(*checks: Unique | Reference) -> DataFrame:
    """(name, kind, key, n): all that breaks the checks; no row where all hold.

    ``kind`` is ``doubled``, ``missing`` or ``null``, ``n`` the number of rows with that key. Rows are counted by key
    on the map side first, so that a key that fills a table reaches a task as one row.
    """
    return reduce(DataFrame.unionByName, [check.violations() for check in checks])


def violation_totals(*checks: Unique | Reference) -> DataFrame:
    """(name, kind, keys, n): how many keys, and rows, break each check in each way."""
    found = violations(*checks)
    return found.groupBy("name", "kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


def _by_key(table: DataFrame, key: tuple[str, ...]) -> DataFrame:
    columns = [F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(key)]
    counted = table.groupBy(*columns).agg(F.count("*").alias("n"))
    null = reduce(lambda a, b: a | b, [F.col(f"_key_{i}").isNull() for i in range(len(key))])
    return counted.withColumn("_null", null)


def _text(columns: list[str]) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def _report(counted: DataFrame, name: str, kind: str) -> DataFrame:
    key = _text([c for c in counted.columns if c.startswith("_key_")])
    return counted.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), key.alias("key"), "n")


def _nulls(counted: DataFrame, name: str) -> DataFrame:
    return _report(counted.where("_null"), name, "null")
