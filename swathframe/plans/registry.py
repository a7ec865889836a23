"""Queries bound to the driver's tables, each with DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import CTE, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def needed(sql: str) -> list[str]:
    """The relations that a text names, those that they need first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(CTE[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_relations(sql: str) -> str:
    sql = sql.strip()
    names = [n for n in needed(sql) if not re.search(rf"\b{n} AS \(", sql)]
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in names)
    if m := re.match(r"WITH (RECURSIVE )?", sql):
        return f"WITH {m[1] or ''}{head}, {sql[m.end() :]}"
    return f"WITH {head} {sql}"


class Relations:
    """Tables and domain relations of one folder as DataFrames: ``t.ship``, ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}") if name in CTE else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = with_relations(text)
        for table in TABLES:
            if re.search(rf"\b{table}\b", text):
                self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return self.spark.sql(text)


def bound(name: str, sql: str | None = None):
    """Register ``query(relations)`` under a name, with its SQL."""

    def register(query: Callable[[Relations], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: query(Relations(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_relations(sql)
        return query

    return register
