"""Projections, filters and column cleaning."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.scalar import _c, contains_ci

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns (bool excluded) minus ``exclude``."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in ex]


def columns_like(df: DataFrame, patterns: Sequence[str], case: bool = True) -> list[str]:
    """Columns whose name contains any pattern (glob ``*`` allowed)."""
    out = []
    for c in df.columns:
        name = c if case else c.lower()
        for p in patterns:
            p2 = p if case else p.lower()
            if ("*" in p2 and fnmatch.fnmatchcase(name, p2)) or ("*" not in p2 and p2 in name):
                out.append(c)
                break
    return out


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    """Schema column set difference, order kept."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def has_column(df: DataFrame, col: str) -> bool:
    """Q10: schema check (case-sensitive)."""
    return col in df.columns


def filter_contains(df: DataFrame, col: str, text: str) -> DataFrame:
    """P5: case-insensitive substring filter; NULL is false."""
    return df.filter(contains_ci(col, text))


def drop_nonpositive(df: DataFrame, col: str) -> DataFrame:
    """Keep rows with a positive value. The removed count is available
    through ``quality.step_log`` without a second scan."""
    return df.filter(F.col(col) > 0)


def valid_pairs(y: str, p: str, positive: bool = True) -> Column:
    """Both values present, finite and (optionally) positive."""
    inf = F.lit(float("inf"))
    cond = (F.col(y).isNotNull() & F.col(p).isNotNull()
            & ~F.isnan(F.col(y)) & ~F.isnan(F.col(p))
            & (F.abs(F.col(y)) != inf) & (F.abs(F.col(p)) != inf))
    if positive:
        cond = cond & (F.col(y) > 0) & (F.col(p) > 0)
    return cond


def missing_shares(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    """Percent missing per column in one aggregate pass (one small row)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(_c(c).isNull()).alias(c) for c in cols]).first()
    n = row["__n"] or 0
    return {c: (100.0 * row[c] / n if n else 0.0) for c in cols}


def drop_sparse_columns(df: DataFrame, max_missing_pct: float = 50.0,
                        cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns whose missing share is above the threshold."""
    shares = missing_shares(df, cols)
    return df.drop(*[c for c, s in shares.items() if s > max_missing_pct])


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+-Infinity (and NaN) to NULL in every floating column."""
    float_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    targets = [c for c in (cols or float_cols) if c in float_cols]
    inf = F.lit(float("inf"))
    return df.withColumns({
        c: F.when(F.isnan(F.col(c)) | (F.abs(F.col(c)) == inf), F.lit(None).cast(df.schema[c].dataType))
        .otherwise(F.col(c)) for c in targets})


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Remaining NULL / NaN / inf to 0 in numeric columns."""
    targets = cols or numeric_columns(df)
    out = {}
    inf = F.lit(float("inf"))
    for c in targets:
        dt = df.schema[c].dataType
        if isinstance(dt, FLOATING):
            out[c] = F.when(F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == inf),
                            F.lit(0.0).cast(dt)).otherwise(F.col(c))
        else:
            out[c] = F.coalesce(F.col(c), F.lit(0).cast(dt))
    return df.withColumns(out)


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to fixed bounds; NULL stays NULL."""
    c = _c(c)
    if hi is not None:
        c = F.when(c.isNull(), c).otherwise(F.least(c, F.lit(hi)))
    if lo is not None:
        c = F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lo)))
    return c


def cap_at_quantile(df: DataFrame, col: str, q: float = 0.99, approx: bool = False,
                    accuracy: int = 10000) -> DataFrame:
    """Upper cap at a quantile. The quantile is one scalar aggregate;
    it is applied as a literal so the projection stays in codegen.

    ``approx=True`` uses a bounded-memory sketch (percentile_approx) instead
    of exact interpolation, for columns with very many distinct values."""
    from panelforge.operators.order_stats import exact_quantiles
    cap = exact_quantiles(df, col, [q], "approx" if approx else "exact")[0]
    if cap is None:
        return df
    return df.withColumn(col, F.when(F.col(col) > F.lit(cap), F.lit(cap)).otherwise(F.col(col)))


def keep_in(df: DataFrame, col: str, values: Sequence | DataFrame, key: str | None = None) -> DataFrame:
    """Literal list -> ``isin``; table -> left semi join."""
    if isinstance(values, DataFrame):
        other_key = key or col
        right = values.select(F.col(other_key).alias(col)).distinct()
        return df.join(right, on=col, how="left_semi")
    return df.filter(F.col(col).isin(list(values)))
