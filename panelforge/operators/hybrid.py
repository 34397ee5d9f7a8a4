"""Hybrid adjustment (H1-H18): a baseline prediction times a bounded
adjustment parsed from stored model responses, with uncertainty bands,
stacking weights and prompt text -- all as column expressions and joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import scalar as S
from panelforge.functions.predicates import clip
from panelforge.operators.aggregates import gram

# Bounds and factors of the reference's adjustment rules.
ADJUST_BOUND = 0.20          # adjust-only rule: a clipped to +-0.20
BAND_FACTOR = 0.7            # bands scale by 1 + 0.7 a
DAMPED_ALPHA = 0.15          # damped rule: clip(raw, +-0.15) * (1 - exp(-band/rmse))
DEFAULT_BAND_SHARE = 0.20    # default band width: 20 % of the prediction
DEFAULT_RMSE_SHARE = 0.10    # default training RMSE: 10 % of the prediction
P10_FACTOR, P90_FACTOR = 0.8, 1.2
CONSTANT_INTERVAL = 0.20
FALLBACK_DIVISOR = 20        # baseline from a total over 20 years
ACRES_PER_UNIT = 180         # per-acre rate used to infer acres from totals


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def adjust(y: str | Column, a: str | Column, bound: float = ADJUST_BOUND) -> Column:
    """H1: ``y * (1 + clip(a, -bound, bound))``."""
    return _c(y) * (1 + clip(_c(a), -bound, bound))


def adjust_bands(p: str | Column, a: str | Column, bound: float = ADJUST_BOUND) -> Column:
    """H2: band limit scaled by ``1 + 0.7 * clip(a)``; NULL stays NULL."""
    return _c(p) * (1 + BAND_FACTOR * clip(_c(a), -bound, bound))


def damped_adjustment(raw: str | Column, band: str | Column, rmse: str | Column,
                      alpha: float = DAMPED_ALPHA) -> Column:
    """H3: ``clip(raw, +-alpha) * (1 - exp(-band / rmse))``."""
    return clip(_c(raw), -alpha, alpha) * S.damping(band, rmse)


def damped_adjust(df: DataFrame, pred: str, raw: str, band: str, rmse: str, alpha: float = DAMPED_ALPHA) -> DataFrame:
    """H3: adjustment, adjusted prediction and 80 % limits."""
    adj = damped_adjustment(raw, band, rmse, alpha)
    d = df.withColumn("adj", adj)
    return d.withColumns({
        "pred_adjusted": F.col(pred) * (1 + F.col("adj")),
        "low_80": (F.col(pred) - 0.5 * F.col(band)) * (1 + BAND_FACTOR * F.col("adj")),
        "high_80": (F.col(pred) + 0.5 * F.col(band)) * (1 + BAND_FACTOR * F.col("adj")),
    })


def default_uncertainty(df: DataFrame, pred: str) -> DataFrame:
    """H4: band 20 % and RMSE 10 % of the prediction; p10 / p90 = 0.8 / 1.2 x."""
    return df.withColumns({"band": F.col(pred) * DEFAULT_BAND_SHARE, "train_rmse": F.col(pred) * DEFAULT_RMSE_SHARE,
                           "p10": F.col(pred) * P10_FACTOR, "p90": F.col(pred) * P90_FACTOR})


def intervals(df: DataFrame, y: str, pred: str, method: str = "quantile", fit_on: Column | None = None,
              qs: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """H5 / H6: prediction limits from residual quantiles (fitted on
    ``fit_on`` rows) or a constant +-20 %."""
    if method == "constant":
        return df.withColumns({"p10": F.col(pred) * (1 - CONSTANT_INTERVAL), "p90": F.col(pred) * (1 + CONSTANT_INTERVAL)})
    from panelforge.operators.order_stats import quantiles_by_column

    fit = df.where(fit_on) if fit_on is not None else df
    res = fit.select((F.col(y) - F.col(pred)).alias("__r"))
    lo, hi = [v if v is not None else 0.0 for v in quantiles_by_column(res, ["__r"], list(qs))["__r"]]
    return df.withColumns({"p10": F.col(pred) + F.lit(lo), "p90": F.col(pred) + F.lit(hi)})


def _simplex_qp(A: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray | None:
    """Exact minimiser of ``w'(A + lam I)w - 2 b'w`` over the simplex
    (``w >= 0, sum w = 1``) by a primal active-set method: solve on the
    current support; if a weight would turn negative, go as far as the first
    one allows and drop it; else add the weight whose slope promises most,
    until none does. Each step is one small linear system, for any number of
    models."""
    m = len(b)
    # to about 1, as the sum's row of ones: else least squares takes it for rounding beside large squares
    scale = float(np.mean(np.diag(A))) + lam or 1.0
    H, b = 2 * (A + lam * np.eye(m)) / scale, b / scale
    w, support = np.full(m, 1.0 / m), list(range(m))
    for _ in range(100 * m):
        size = len(support)
        K = np.zeros((size + 1, size + 1))
        K[:size, :size] = H[np.ix_(support, support)]
        K[:size, size] = K[size, :size] = 1.0
        target = np.zeros(m)
        target[support] = np.linalg.lstsq(K, np.append(2 * b[support], 1.0), rcond=None)[0][:size]
        if target[support].min() < -1e-12:
            step = target - w
            falls = [k for k in support if step[k] < 0]
            first = min(falls, key=lambda k: -w[k] / step[k])
            w = np.clip(w + max(0.0, -w[first] / step[first]) * step, 0, None)
            w[first] = 0.0
            support.remove(first)
            continue
        w = np.clip(target, 0, None)
        w /= w.sum()
        slope = H @ w - 2 * b
        level = slope[support].min()
        better = [k for k in range(m) if k not in support and slope[k] < level - 1e-9 * (1 + abs(level))]
        if not better:
            return w
        support.append(min(better, key=lambda k: slope[k]))
    return w


def fit_stack(df: DataFrame, preds: Sequence[str], y: str, lam: float = 0.1) -> dict[str, float]:
    """H7: stacking weights ``argmin mean((y - Z w)^2) + lam |w|^2`` with
    ``w >= 0, sum w = 1``. The data work is one Gram aggregate (A34); the
    m x m problem (m <= 10) is solved exactly on the driver. Uniform
    weights when there are no complete rows or no solution."""
    m = len(preds)
    d = df.where(F.col(y).isNotNull())
    for p in preds:
        d = d.where(F.col(p).isNotNull())
    g = gram(d, list(preds), y)
    n = g["n"]
    if not n:
        return {p: 1.0 / m for p in preds}
    A = np.array(g["ZtZ"]) / n
    b = np.array(g["Zty"]) / n
    w = _simplex_qp(A, b, lam)
    if w is None:
        w = np.full(m, 1.0 / m)
    return {p: float(x) for p, x in zip(preds, w)}


def stack(df: DataFrame, weights: dict[str, float], out: str = "y_stack") -> DataFrame:
    """H8: weighted sum of prediction columns."""
    expr = sum((F.col(p) * F.lit(w) for p, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, expr)


def hybrid(df: DataFrame, pred: str, adj: str, method: str = "adjust_only", stack_cols: Sequence[str] = (),
           weights: dict[str, float] | None = None, out: str = "y_hybrid") -> DataFrame:
    """H9: method choice; ``stacked`` falls back to adjust-only per row when
    a stacking input is missing."""
    if method not in ("adjust_only", "stacked"):
        raise ValueError(f"unknown hybrid method {method!r}; choose adjust_only or stacked")
    base = adjust(pred, F.coalesce(F.col(adj), F.lit(0.0)))
    if method == "adjust_only" or not weights:
        return df.withColumn(out, base)
    complete = None
    for c in stack_cols:
        cond = F.col(c).isNotNull()
        complete = cond if complete is None else complete & cond
    stacked = sum((F.col(p) * F.lit(w) for p, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, F.when(complete, stacked).otherwise(base))


RESPONSE_SCHEMA = T.StructType([
    T.StructField("adjustment", T.DoubleType()), T.StructField("adj_raw", T.DoubleType()),
    T.StructField("adj", T.DoubleType()), T.StructField("drivers", T.ArrayType(T.StringType()))])


def parse_adjustments(df: DataFrame, text_col: str, bound: float = ADJUST_BOUND,
                      schema: T.StructType = RESPONSE_SCHEMA) -> DataFrame:
    """Response text (optionally in a code fence) -> adjustment clipped
    to the bound (missing field -> 0.0), drivers, and a parse-success flag;
    unparseable text falls back to 0.0 with ``parsed = false``."""
    js = S.parse_json_fields(text_col, schema, with_corrupt=True)
    d = df.withColumn("__js", js)
    ok = (F.col("__js").isNotNull() & F.col(f"__js.{S.CORRUPT}").isNull() & F.col(text_col).isNotNull()
          & (F.trim(F.col(text_col)) != ""))
    raw = F.coalesce(F.col("__js.adjustment"), F.col("__js.adj"), F.lit(0.0))
    return d.withColumns({
        "parsed": ok,
        "adjustment": F.when(ok, clip(raw, -bound, bound)).otherwise(F.lit(0.0)),
        "drivers": F.when(ok, F.coalesce(F.col("__js.drivers"), F.array().cast("array<string>"))),
    }).drop("__js")


def hybrid_batch(preds: DataFrame, adjustments: DataFrame, keys: Sequence[str], pred: str) -> DataFrame:
    """Per-row hybrid with fallback adjustment 0.0 where no response."""
    d = preds.join(adjustments, on=list(keys), how="left")
    a = F.coalesce(F.col("adjustment"), F.lit(0.0))
    return d.withColumns({"adjustment": a, "y_hybrid": adjust(pred, a), "fallback": F.col("parsed").isNull()})


def baseline(model_value: str | Column, recent_mean: str | Column, total: str | Column) -> Column:
    """Model value, else mean of the last 3 years, else total / 20."""
    return F.coalesce(_c(model_value), _c(recent_mean), _c(total) / FALLBACK_DIVISOR)


def to_total(df: DataFrame, per_acre: str, acres: str, actual: str, key: str, out: str = "total") -> DataFrame:
    """Per-acre prediction to a total with the acres fallback chain.
    Entity means come from an aggregate joined back (partial aggregation)."""
    m = df.groupBy(key).agg(F.avg(acres).alias("__ma"), F.avg(actual).alias("__my"))
    d = df.join(m, key, "left")
    a = F.coalesce(F.col(acres), F.col(actual) / ACRES_PER_UNIT, F.col("__ma"), F.col("__my") / ACRES_PER_UNIT)
    return d.withColumns({"acres_used": a, out: F.col(per_acre) * a}).drop("__ma", "__my")


def build_prompts(df: DataFrame, key: str, name: str, pred: str, history: str | None = None,
                  out: str = "prompt", decimals: int = 0) -> DataFrame:
    """Prompt text per entity with thousands separators."""
    parts = [F.lit("Entity "), F.col(name).cast("string"), F.lit(" (key "), F.col(key).cast("string"),
             F.lit("): baseline prediction "), S.thousands(pred, decimals), F.lit(" units.")]
    if history:
        parts += [F.lit(" Recent values: "),
                  F.array_join(F.transform(F.col(history), lambda x: F.format_number(x, decimals)), "; "), F.lit(".")]
    return df.withColumn(out, F.concat(*parts))


def build_batch_prompt(df: DataFrame, rank: str, line: str, k: int = 10, header: str = "") -> DataFrame:
    """The top-k entities' lines, in rank order, in one text. The
    input is cut to ``k`` rows first, so the collected text is bounded."""
    top = df.orderBy(rank).limit(k)
    arr = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(line).alias("l"))))
    return top.agg(F.concat(F.lit(header), F.array_join(F.transform(arr, lambda x: x["l"]), "\n")).alias("batch_prompt"))


def drivers_ok(col: str, lo: int = 3, hi: int = 5) -> Column:
    """Driver list size check."""
    return F.size(F.col(col)).between(lo, hi)
