"""Registry of named queries over the driver tables and their DuckDB twins.

A query is ``fn(spark, sf_dir) -> DataFrame``; the optional SQL is the
independent ANSI formulation the oracle runs on the same Parquet tables.
Every result is normalised to BIGINT / DOUBLE / STRING columns so both sides
compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def normalize(df: DataFrame) -> DataFrame:
    """Integral and boolean -> BIGINT, float/decimal -> DOUBLE; others unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    """Register ``fn`` under ``name`` (with its oracle SQL when it has one)."""
    def deco(fn):
        def run(spark, sf_dir):
            return normalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        OPERATORS[name] = ops
        return fn
    return deco
