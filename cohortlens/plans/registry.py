"""Registry of runnable queries and the SQL text each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6):
    """Registers a query. Doubles are rounded alike on both sides; sql may use the stand-in views by name."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            fixed = ", ".join(
                f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN round(CAST({c} AS DOUBLE), {digits}) + 0.0 END AS {c}"
                for c in doubles
            )
            body = f"SELECT * REPLACE ({fixed}) FROM ({sql}) AS q" if doubles else sql
            ORACLES[name] = with_views(body)
        return fn

    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to a fixed number of digits and no negative zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
