"""Feature engineering.

Each feature is a native column expression with its required inputs; a
feature whose inputs are absent is skipped, as the reference does. Two
features divide by or into the target (``yield_per_acre``,
``revenue_per_bushel``); they are built but tagged ``leaks_target`` and kept
out of model inputs unless ``include_leaky=True``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions.predicates import columns_like
from panelforge.session import cut_lineage


@dataclass(frozen=True)
class Feature:
    name: str
    inputs: tuple[str, ...]
    build: Callable[..., Column]
    leaks_target: bool = False


# The reference's engineered feature definitions (E5, E7-E13,
# E16-E19) by the reference's input column names.
FEATURE_DEFS = (
    ("soil_moisture_gradient", "sub", ("SoilMoi100_200cm_inst", "SoilMoi0_10cm_inst"), False),
    ("temperature_range", "sub", ("prism_tmax_degf", "prism_tmin_degf"), False),
    ("precipitation_evap_balance", "sub", ("prism_ppt_in", "Evap_tavg"), False),
    ("precipitation_efficiency", "ratio", ("SoilMoi0_10cm_inst", "prism_ppt_in"), False),
    ("yield_per_acre", "ratio", ("corn_production_bu", "corn_acres_planted"), True),
    ("fuel_cost_proxy", "mul", ("diesel_usd_gal", "corn_acres_planted"), False),
    ("total_revenue_sources", "add", ("income_farmrelated_receipts_total_usd", "govt_programs_federal_receipts_usd"), False),
    ("revenue_per_bushel", "ratio", ("income_farmrelated_receipts_total_usd", "corn_production_bu"), True),
    ("evap_moist_interact", "mul", ("Evap_tavg", "SoilMoi0_10cm_inst"), False),
    ("soil_evap_ratio", "ratio", ("SoilMoi0_10cm_inst", "Evap_tavg"), False),
    ("temp_gradient", "sub", ("SoilTMP0_10cm_inst", "SoilTMP100_200cm_inst"), False),
    ("wind_moist_interact", "mul", ("Wind_f_inst", "SoilMoi0_10cm_inst"), False),
)

_OPS = {
    "sub": lambda a, b: F.col(a) - F.col(b),
    "add": lambda a, b: F.col(a) + F.col(b),
    "mul": lambda a, b: F.col(a) * F.col(b),
    "ratio": lambda a, b: S.guarded_ratio(a, b),
}


def registry(columns: dict[str, str] | None = None) -> list[Feature]:
    """The engineered features; ``columns`` maps a reference input name to
    the column that plays its role in the data at hand."""
    m = columns or {}
    out = []
    for name, op, (a, b), leaky in FEATURE_DEFS:
        ca, cb = m.get(a, a), m.get(b, b)
        out.append(Feature(name, (ca, cb), (lambda f=_OPS[op], x=ca, y=cb: f(x, y)), leaks_target=leaky))
    return out


def add_features(df: DataFrame, features: Sequence[Feature], names: Sequence[str] | None = None,
                 include_leaky: bool = False) -> tuple[DataFrame, list[str]]:
    """Add every feature whose inputs exist; returns (df, model-input names).
    Leaky features are added but listed as inputs only with ``include_leaky``."""
    new, used = {}, []
    for f in features:
        if names is not None and f.name not in names:
            continue
        if all(i in df.columns for i in f.inputs):
            new[f.name] = f.build()
            if include_leaky or not f.leaks_target:
                used.append(f.name)
    return df.withColumns(new), used


# E1, E2, E3 ------------------------------------------------------------------
def year_trend(df: DataFrame, year: str, base: int | None = None, out: str = "year_trend") -> DataFrame:
    """``year - min(year)`` (one scalar aggregate); E2: ``year - base``."""
    if base is None:
        base = df.agg(F.min(year).alias("m")).first()["m"]
    return df.withColumn(out, F.col(year) - F.lit(base))


def month_features(df: DataFrame, month: str) -> DataFrame:
    """Cyclic month encoding."""
    return df.withColumns({"month_sin": S.month_sin(month), "month_cos": S.month_cos(month)})


# E4, E6 ---------------------------------------------------------------------
SOIL_MOISTURE_PATTERNS = ("SoilMoi",)
# The reference's temperature name patterns (the lower-case
# ones are matched case-insensitively).
TEMPERATURE_PATTERNS = ("Temp", "Tair", "Tveg")
TEMPERATURE_PATTERNS_CI = ("tmean", "tmin", "tmax")


def pattern_mean(df: DataFrame, patterns: Sequence[str], out: str, ci_patterns: Sequence[str] = (),
                 min_cols: int = 2, candidates: Sequence[str] | None = None) -> DataFrame:
    """Row mean over the columns whose names match (NULLs skipped)."""
    pool = list(candidates) if candidates is not None else df.columns
    sub = df.select(*pool) if candidates is not None else df
    cols = columns_like(sub, patterns)
    cols += [c for c in columns_like(sub, ci_patterns, case=False) if c not in cols]
    if len(cols) < min_cols:
        return df
    return df.withColumn(out, S.row_mean(cols))


# E14, E15 --------------------------------------------------------------------
# Distance bin edges and labels of the reference.
DIST_EDGES = (0.0, 25.0, 50.0, 100.0, float("inf"))
DIST_LABELS = ("Very Close", "Close", "Medium", "Far")


def cut(c: str | Column, edges: Sequence[float] = DIST_EDGES, labels: Sequence[str] = DIST_LABELS) -> Column:
    """Right-closed bins, lowest edge excluded (``pd.cut`` defaults):
    a value equal to the first edge gets NULL."""
    col = F.col(c) if isinstance(c, str) else c
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col > F.lit(lo)) & (col <= F.lit(hi))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def one_hot(df: DataFrame, cat: str, levels: Sequence[str], prefix: str) -> DataFrame:
    """One boolean column per fixed level; NULL category -> all False."""
    return df.withColumns({f"{prefix}_{lv}": F.coalesce(F.col(cat) == F.lit(lv), F.lit(False)) for lv in levels})


# E20, E21 --------------------------------------------------------------------
def log_target(df: DataFrame, target: str, out: str = "log_target") -> DataFrame:
    return df.withColumn(out, S.log1p_safe(target))


def quantile_edges(df: DataFrame, col: str, q: int = 4, approx: bool = False) -> list[float]:
    from panelforge.operators.order_stats import exact_quantiles
    return exact_quantiles(df, col, [i / q for i in range(q + 1)], "approx" if approx else "exact")


def qcut_label(c: str | Column, edges: Sequence[float]) -> Column:
    """0-based bin of quantile edges, right-closed, lowest included."""
    col = F.col(c) if isinstance(c, str) else c
    inner = edges[1:-1]
    expr = F.when(col.isNull(), F.lit(None))
    for i, e in enumerate(inner):
        expr = expr.when(col <= F.lit(e), F.lit(i))
    return expr.otherwise(F.lit(len(inner)))


def target_quartile(df: DataFrame, target: str, out: str = "target_quartile", q: int = 4) -> DataFrame:
    df = cut_lineage(df)  # edges and labels from the same values, also where the target is a sum of doubles
    return df.withColumn(out, qcut_label(target, quantile_edges(df, target, q)))


# E22, E23 --------------------------------------------------------------------
def target_encode(df: DataFrame, key: str, target: str, fit_on: Column | None = None,
                  min_samples_leaf: int = 20, smoothing: float = 10.0, out: str | None = None) -> DataFrame:
    """Smoothed target encoding of ``key``.

    Statistics come from the rows selected by ``fit_on`` (train rows; None =
    all rows, the leaky variant). ``s = 1/(1+exp(-(n-k)/f))``; encoding =
    ``prior*(1-s) + mean*s``; keys seen once and unseen keys get the prior,
    as the public encoder library does."""
    fit = df.where(fit_on) if fit_on is not None else df
    prior = fit.agg(F.avg(target).alias("p")).first()["p"]
    stats = fit.groupBy(key).agg(F.count(target).alias("__n"), F.avg(target).alias("__m"))
    s = 1 / (1 + F.exp(-(F.col("__n") - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    enc = F.when(F.col("__n") == 1, F.lit(prior)).otherwise(F.lit(prior) * (1 - s) + F.col("__m") * s)
    stats = stats.select(key, enc.alias("__enc"))
    out = out or f"{key}_encoded"
    res = df.join(stats, on=key, how="left")
    return res.withColumn(out, F.coalesce(F.col("__enc"), F.lit(prior))).drop("__enc")


# E24 ------------------------------------------------------------------------
def inverse_weight(df: DataFrame, target: str, out: str = "sample_weight") -> DataFrame:
    """``1/(y+1)`` scaled to mean 1."""
    raw = 1 / (F.col(target) + 1)
    m = df.agg(F.avg(raw).alias("m")).first()["m"]
    return df.withColumn(out, raw / F.lit(m))
