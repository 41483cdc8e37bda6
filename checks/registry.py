"""Registration of queries with their optional SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyorder.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """All double columns rounded, as in the SQL twins; -0.0 becomes 0.0."""
    return df.select(
        *[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def round_sql(body: str, doubles: str, rest: str, digits: int = 8) -> str:
    """SELECT of `rest` columns as they are and `doubles` rounded, from a body."""
    cols = [c.strip() for c in doubles.split(",") if c.strip()]
    return "SELECT " + ", ".join([c.strip() for c in rest.split(",") if c.strip()] + [f"round({c}, {digits}) + 0.0 AS {c}" for c in cols]) + " FROM " + body


def rounded_where(df: DataFrame, flag: str, digits: int = 4, otherwise: int = 6) -> DataFrame:
    """Computed rows (flag) and stored rows (not flag) rounded to different digits."""
    return df.select(
        *[
            (F.when(F.expr(flag), F.round(c, digits)).otherwise(F.round(c, otherwise)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )
