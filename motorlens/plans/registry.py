"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one can be written, its SQL twin."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(function(spark, sf_dir))

        run.__name__ = name
        run.unrounded = function
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Round floating columns to six decimals and drop negative zero, for comparison between engines.

    The small shift keeps exact decimal ties from being decided by the last bit.
    """
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = (F.rint((column + F.lit(3e-10)) * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)).alias(field.name)
        columns.append(column)
    return df.select(*columns)
