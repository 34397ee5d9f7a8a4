"""ML preparation: scaling, imputation, splits, sequences.

Scalers and imputers are fitted by one aggregate over the selected rows --
one small row of statistics bounded by the column count -- and applied as
literal expressions (no join, stays in codegen). ``fit_on`` selects the
fitting rows: a boolean Column (train rows), or None for all rows, which
reproduces the reference's fit-before-split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import seeded_order
from panelforge.spec import PanelSpec


@dataclass
class Stats:
    """Fitted per-column statistics: ``center`` and ``scale`` (or fill)."""
    kind: str
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def to_df(self, spark):
        rows = [(c, self.center.get(c), self.scale.get(c)) for c in self.center]
        return spark.createDataFrame(rows, "column string, center double, scale double")


def _fit_rows(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df.where(fit_on) if fit_on is not None else df


def fit_robust(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None, approx: bool = False) -> Stats:
    """M1: median and IQR (25-75, linear); IQR 0 -> 1."""
    from panelforge.operators.order_stats import quantiles_by_column
    d = _fit_rows(df, fit_on)
    quart = quantiles_by_column(d, cols, [0.25, 0.5, 0.75], "approx" if approx else "exact")
    st = Stats("robust")
    for c in cols:
        q = quart[c]
        if q[0] is None:
            st.center[c], st.scale[c] = 0.0, 1.0
            continue
        iqr = float(q[2]) - float(q[0])
        st.center[c], st.scale[c] = float(q[1]), (iqr if iqr != 0 else 1.0)
    return st


def fit_standard(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> Stats:
    """M2 / M3: mean and population std (sklearn rule); std 0 -> 1."""
    d = _fit_rows(df, fit_on)
    row = d.agg(*[F.avg(c).alias(f"m|{c}") for c in cols], *[F.stddev_pop(c).alias(f"s|{c}") for c in cols]).first()
    st = Stats("standard")
    for c in cols:
        m, s = row[f"m|{c}"], row[f"s|{c}"]
        st.center[c] = float(m) if m is not None else 0.0
        st.scale[c] = float(s) if s not in (None, 0.0) else 1.0
    return st


def fit_minmax(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> Stats:
    """M5: min and range; range 0 -> 1."""
    d = _fit_rows(df, fit_on)
    row = d.agg(*[F.min(c).alias(f"lo|{c}") for c in cols], *[F.max(c).alias(f"hi|{c}") for c in cols]).first()
    st = Stats("minmax")
    for c in cols:
        lo, hi = row[f"lo|{c}"], row[f"hi|{c}"]
        lo = float(lo) if lo is not None else 0.0
        rng = (float(hi) - lo) if hi is not None else 1.0
        st.center[c], st.scale[c] = lo, (rng if rng != 0 else 1.0)
    return st


def transform(df: DataFrame, st: Stats, suffix: str = "") -> DataFrame:
    """Apply fitted statistics: ``(x - center) / scale``."""
    return df.withColumns({c + suffix: (F.col(c) - F.lit(st.center[c])) / F.lit(st.scale[c])
                           for c in st.center if c in df.columns})


def inverse(df: DataFrame, st: Stats, cols: Sequence[str] | None = None, suffix: str = "") -> DataFrame:
    """Reverse projection ``x * scale + center`` from saved statistics."""
    cols = cols or list(st.center)
    return df.withColumns({c + suffix: F.col(c) * F.lit(st.scale[c]) + F.lit(st.center[c]) for c in cols})


def robust_scale(df, cols, fit_on=None, approx=False):
    return transform(df, fit_robust(df, cols, fit_on, approx))


def standard_scale(df, cols, fit_on=None):
    return transform(df, fit_standard(df, cols, fit_on))


# M6, M7, M8 -------------------------------------------------------------------
def fit_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "median", fit_on: Column | None = None,
                approx: bool = False) -> Stats:
    d = _fit_rows(df, fit_on)
    if strategy == "median":
        from panelforge.operators.order_stats import exact_quantiles
        return Stats("median", center={c: exact_quantiles(d, c, [0.5], "approx" if approx else "exact")[0]
                                       for c in cols})
    if strategy == "mean":
        aggs = [F.avg(c).alias(c) for c in cols]
    else:
        raise ValueError(strategy)
    row = d.agg(*aggs).first()
    return Stats(strategy, center={c: (float(row[c]) if row[c] is not None else None) for c in cols})


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "median", fit_on: Column | None = None,
           approx: bool = False) -> DataFrame:
    """M6 / M7: fill NULLs with the training median / mean."""
    st = fit_imputer(df, cols, strategy, fit_on, approx)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in st.center.items() if v is not None})


def impute_group_mean(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """M8: entity mean, then global mean (aggregate then join: partial
    aggregation keeps a hot entity cheap)."""
    g = df.groupBy(key).agg(*[F.avg(c).alias(f"__g_{c}") for c in cols])
    glob = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    out = df.join(g, on=key, how="left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__g_{c}"), F.lit(glob[c])) for c in cols}).select(*df.columns)


# M9, M10, M11, M12 --------------------------------------------------------------
def temporal_split(df: DataFrame, year: str, first_test_year: int) -> tuple[DataFrame, DataFrame]:
    """M9: train = years before the cut-off, test = the rest."""
    return df.where(F.col(year) < first_test_year), df.where(F.col(year) >= first_test_year)


def split_label(year: str, first_test_year: int) -> Column:
    return F.when(F.col(year) < first_test_year, F.lit("train")).otherwise(F.lit("test"))


def kfold(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Seeded shuffled folds whose sizes differ by one row at most: the
    row's place in a seeded order of the key, modulo ``k``."""
    from panelforge.operators.windows import global_row_index

    d = df.withColumn("__h", seeded_order(keys, seed))
    d = global_row_index(d, ["__h", *keys], out="__i")
    return d.withColumn(out, F.pmod(F.col("__i") - 1, F.lit(k)).cast("int")).drop("__h", "__i")


def random_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Hash hold-out of a fixed share."""
    u = F.conv(F.substring(seeded_order(keys, seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return df.withColumn(out, F.when(u < test_share, F.lit("test")).otherwise(F.lit("train")))


def balance(df: DataFrame, label: str, split: str) -> DataFrame:
    """Label shares within each split."""
    cnt = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    tot = df.groupBy(split).agg(F.count(F.lit(1)).alias("__t"))
    return cnt.join(tot, split).withColumn("share", F.col("n") / F.col("__t")).drop("__t")


# M17, M18 ---------------------------------------------------------------------
def sequences(df: DataFrame, spec: PanelSpec, cols: Sequence[str], months: Sequence[int] = tuple(range(2, 9)),
              mode: str = "strict", out: str = "sequence") -> DataFrame:
    """One (months x features) matrix per (entity, year).

    ``strict`` keeps groups with exactly ``len(months)`` rows; ``pad``
    appends zero rows at the end up to that length and drops longer groups.
    Groups are bounded by the month list, so the collect is bounded."""
    m = spec.month
    d = df.where(F.col(m).isin(list(months)))
    st = F.struct(F.col(m).alias("__o"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    g = d.groupBy(spec.entity, spec.year).agg(F.array_sort(F.collect_list(st)).alias("__s"))
    g = g.withColumn(out, F.transform("__s", lambda x: x["v"])).withColumn("n_steps", F.size("__s")).drop("__s")
    T = len(months)
    if mode == "strict":
        return g.where(F.col("n_steps") == T)
    zero = F.array(*[F.lit(0.0) for _ in cols])
    g = g.where(F.col("n_steps") <= T)
    return g.withColumn(out, F.concat(F.col(out), F.array_repeat(zero, F.lit(T) - F.col("n_steps"))))
