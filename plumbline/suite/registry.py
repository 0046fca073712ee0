"""Query registry and shared inputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import TABLES, read_table
from plumbline.suite.inputs import INPUTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_inputs(sql: str, given: Iterable[str] = ()) -> str:
    """Puts the inputs a statement names (fx_...) in front of it as common table expressions, but for those that are given."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name not in ordered and name not in given:
                visit(INPUTS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} as ({INPUTS[name].strip()})" for name in ordered)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, root)`` under a name, with its oracle SQL if there is one."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return fn

    return add


_SCANS: dict[tuple[str, str, str], DataFrame] = {}


def table_scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table; its schema is read once per application."""
    key = (spark.sparkContext.applicationId, root, name)
    if key not in _SCANS:
        _SCANS[key] = read_table(spark, root, name)
    return _SCANS[key]


def load(spark: SparkSession, root: str, statement: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A shared input (by name) or a SELECT over tables and inputs; ``given`` are the rows of inputs that were read already."""
    given = given or {}
    text = with_inputs(f"select * from {statement}" if re.fullmatch(r"\w+", statement) else statement, given)
    for name, rows in given.items():
        rows.createOrReplaceTempView(name)
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            table_scan(spark, root, table).createOrReplaceTempView(table)
    return spark.sql(text)
