"""Evaluation (V1-V19): metrics as single aggregates, groupable by model,
quartile or entity, so any number of models is scored in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order_stats import exact_quantiles

from panelforge.functions import scalar as S
from panelforge.functions.predicates import valid_pairs


def metric_aggs(y: str | Column, p: str | Column, eps: float | None = 1e-8) -> list[Column]:
    """n, RMSE, MAE, R2, MAPE (V1-V3). SST uses ``var_pop * n`` (a
    numerically stable merge) rather than ``sum(y^2) - n mean^2``."""
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    err = y - p
    n = F.count(err)
    yv = F.when(err.isNotNull(), y)
    mape_term = F.abs(err / (y + F.lit(eps))) if eps else F.abs(F.try_divide(err, y))
    return [n.alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
            (1 - F.sum(err * err) / (F.var_pop(yv) * n)).alias("r2"),
            (F.avg(mape_term) * 100).alias("mape")]


def metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float | None = 1e-8,
            scale: str | None = None) -> DataFrame:
    """V1-V4: metrics, optionally per group and on a log scale
    (``scale='log'`` = ln, ``'log1p'``)."""
    yc, pc = F.col(y), F.col(p)
    if scale == "log":
        yc, pc = S.ln_safe(yc), S.ln_safe(pc)
    elif scale == "log1p":
        yc, pc = S.log1p_safe(yc), S.log1p_safe(pc)
    aggs = metric_aggs(yc, pc, eps)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def long_predictions(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str]) -> DataFrame:
    """Wide per-model prediction columns to (keys, y, model, pred)."""
    return df.select(*keys, y, *models).unpivot([*keys, y], list(models), "model", "pred")


def leaderboard(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str], positive: bool = True,
                eps: float | None = 1e-8, scale: str | None = None) -> DataFrame:
    """V5: every model at once from a wide table; each model is scored on
    its own valid rows (present, finite, positive)."""
    long = long_predictions(df, keys, y, models).where(valid_pairs(y, "pred", positive))
    return metrics(long, y, "pred", by=["model"], eps=eps, scale=scale)


def ranked_leaderboard(board: DataFrame, classes: DataFrame | None = None, by: str = "r2") -> DataFrame:
    """V6: leaderboard joined with a small model dimension (complexity class)
    and sorted by score descending, then name."""
    b = board.join(classes, "model", "left") if classes is not None else board
    return b.orderBy(F.desc(by), F.asc("model"))


def residual_summary(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """V7: residual (y - p) mean, sample std, min, max."""
    r = F.col(y) - F.col(p)
    aggs = [F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("std_residual"),
            F.min(r).alias("min_residual"), F.max(r).alias("max_residual")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def error_percentiles(df: DataFrame, y: str, p: str, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.95),
                      eps: float = 1e-6, approx: bool = False) -> DataFrame:
    """V8: percentiles of the absolute percent error."""
    pe = F.abs(F.col(y) - F.col(p)) / (F.col(y) + F.lit(eps)) * 100
    got = exact_quantiles(df.select(pe.alias("__pe")), "__pe", list(qs), "approx" if approx else "exact")
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(f"p{int(round(q * 100))}")
                                             for v, q in zip(got, qs)])


# Grading thresholds of the reference.
EXCELLENT_R2, GOOD_R2, FAIR_R2 = 0.90, 0.80, 0.70
EXCELLENT_RMSE_RATIO, GOOD_RMSE_RATIO = 0.10, 0.20


def assess(m: DataFrame, mean_col: str = "mean_y") -> DataFrame:
    """R2 grade, RMSE-share grade, MAPE grade and overall grade."""
    ratio = F.try_divide(F.col("rmse"), F.col(mean_col))
    r2g = S.graded("r2", [(EXCELLENT_R2, "EXCELLENT"), (GOOD_R2, "GOOD"), (FAIR_R2, "FAIR")], "POOR")
    rg = S.graded(ratio, [(EXCELLENT_RMSE_RATIO, "EXCELLENT"), (GOOD_RMSE_RATIO, "GOOD")], "MODERATE",
                  higher_is_better=False)
    mg = (F.when(F.col("mape") < 20, "EXCELLENT").when(F.col("mape") < 30, "GOOD")
          .when(F.col("mape") < 50, "MODERATE").otherwise("HIGH"))
    overall = (F.when((F.col("r2") >= EXCELLENT_R2) & (ratio <= GOOD_RMSE_RATIO), "EXCELLENT")
               .when((F.col("r2") >= GOOD_R2) & (ratio <= GOOD_RMSE_RATIO * 1.5), "GOOD")
               .when(F.col("r2") >= FAIR_R2, "FAIR").otherwise("NEEDS IMPROVEMENT"))
    return m.withColumns({"rmse_ratio": ratio, "r2_grade": r2g, "rmse_grade": rg, "mape_grade": mg,
                          "overall": overall})


def metrics_with_mean(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    aggs = metric_aggs(y, p, eps) + [F.avg(y).alias("mean_y")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def improvements(stages: DataFrame, order: str, cols: Sequence[str]) -> DataFrame:
    """Change of each metric from the previous stage (small table)."""
    w = Window.orderBy(order)
    return stages.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(w) for c in cols})


def result_table(df: DataFrame, keys: Sequence[str], y_log: str, p_log: str) -> DataFrame:
    """Back-transformed values, residual (predicted - actual) and
    absolute error per row."""
    return df.select(*keys, F.col(y_log).alias("actual_log"), F.col(p_log).alias("predicted_log"),
                     F.expm1(y_log).alias("actual_original"), F.expm1(p_log).alias("predicted_original"),
                     (F.col(p_log) - F.col(y_log)).alias("residual_log"),
                     F.abs(F.expm1(p_log) - F.expm1(y_log)).alias("abs_error_original"))


def entity_errors(df: DataFrame, key: str, y: str, a: str, b: str) -> DataFrame:
    """Per-entity error and percent error of two models."""
    return df.select(key, y, a, b, (F.col(a) - F.col(y)).alias(f"{a}_error"), (F.col(b) - F.col(y)).alias(f"{b}_error"),
                     S.pct_error(y, a).alias(f"{a}_pct_error"), S.pct_error(y, b).alias(f"{b}_pct_error"))


def prediction_health(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinite predictions per column."""
    inf = F.lit(float("inf"))
    rows = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.isnan(c)).alias("n_nan"),
                     F.count_if(F.abs(F.col(c)) == inf).alias("n_inf")) for c in cols]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def bias_flags(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Systematic bias when |mean residual| > 5 % of mean actual;
    high error variance when residual std > 0.8 RMSE."""
    r = F.col(y) - F.col(p)
    aggs = [F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("std_residual"),
            F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(y).alias("mean_y")]
    m = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return m.withColumns({"biased": F.abs(F.col("mean_residual")) > F.col("mean_y") * 0.05,
                          "high_variance": F.col("std_residual") > F.col("rmse") * 0.8})


def timed_fit(estimator, df: DataFrame):
    """Fit with the driver's wall clock around it; returns (model, seconds)."""
    import time

    t0 = time.perf_counter()
    model = estimator.fit(df)
    return model, time.perf_counter() - t0
