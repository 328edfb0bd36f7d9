"""What the plan modules register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Digits of doubles in results, in queries and oracles alike.
DIGITS = 9


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with DuckDB SQL for the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"a query is registered as {name!r} already")
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, negative zeros turned positive."""
    return df.select(*[(F.round(c, DIGITS) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str) -> str:
    """The same in an oracle."""
    return f"(round(CAST({expr} AS DOUBLE), {DIGITS}) + 0.0)"
