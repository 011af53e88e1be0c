"""One registry of queries.

An entry names its output columns with a one-letter kind; both sides get the same last projection:
``s`` text, ``i`` whole number, ``d`` double rounded to six digits, ``t`` timestamp as text,
``b`` boolean as 0/1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    columns: str
    build: Build
    sql: str | None

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(f.split(":")) for f in self.columns.split()]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(spark, folder).select(*[_spark_cell(n, k) for n, k in self.fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cells = ", ".join(_sql_cell(n, k) for n, k in self.fields())
        return f"SELECT {cells} FROM ({self.sql.strip()}) AS result_rows"


def _spark_cell(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "d":
        x = c.cast("double")
        r = F.floor(x * 1e6 + 0.5) / 1e6
        return F.when(F.isnan(x), None).when(F.abs(x) >= 1e9, x).when(r == 0, F.lit(0.0)).otherwise(r).alias(name)
    if kind in "ib":
        return c.cast("long").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    return c.cast("string").alias(name)


def _sql_cell(name: str, kind: str) -> str:
    if kind == "d":
        x = f"CAST({name} AS DOUBLE)"
        r = f"floor({x} * 1e6 + 0.5) / 1e6"
        return (f"CASE WHEN isnan({x}) THEN NULL WHEN abs({x}) >= 1e9 THEN {x} WHEN {r} = 0 THEN 0.0::DOUBLE "
                f"ELSE {r} END AS {name}")
    if kind in "ib":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}"


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, operators, columns, build, sql)
        return build
    return register
