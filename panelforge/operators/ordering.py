"""Sorts, limits, top-k and sampling.

Global top-k is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: every task keeps its own k best rows and only
``k x tasks`` rows reach the final merge. Ties are always broken by key so
results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import seeded_order


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def sort(df: DataFrame, *order: str | Column) -> DataFrame:
    """O1 / O2: multi-key, mixed-direction sort (range-partitioned)."""
    return df.orderBy(*_cols(order))


def top_k(df: DataFrame, col: str, k: int, tie_keys: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """K rows with the largest (or smallest) value."""
    o = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return df.orderBy(o, *_cols(tie_keys)).limit(k)


def head_tail(df: DataFrame, col: str, n: int, tie_keys: Sequence[str] = ()) -> DataFrame:
    """The n largest and n smallest rows, tagged by end."""
    head = top_k(df, col, n, tie_keys).withColumn("end", F.lit("top"))
    tail = top_k(df, col, n, tie_keys, ascending=True).withColumn("end", F.lit("bottom"))
    return head.unionByName(tail)


def limit_samples(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Deterministic row cap for batch scoring (first n by key)."""
    return df.orderBy(*_cols(keys)).limit(n)


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Fixed-size sample without replacement. The row order is a seeded
    hash of the key, so the sample is reproducible and independent of the
    partitioning (unlike ``sample`` + ``limit``)."""
    return df.withColumn("__h", seeded_order(keys, seed)).orderBy("__h", *_cols(keys)).limit(n).drop("__h")


def pick_row(df: DataFrame, keys: Sequence[str], position: int, partitions: int | None = None) -> DataFrame:
    """The row at 0-based ``position`` in key order.

    Taken from the distributed global row index, whose ranges are written
    once, so counts and ranks agree on the range boundaries."""
    from panelforge.operators.windows import global_row_index

    idx = global_row_index(df, list(keys), partitions=partitions, out="__i")
    return idx.where(F.col("__i") == position + 1).drop("__i")
