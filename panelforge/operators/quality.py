"""Data quality and profiling (Q1-Q12). Each report is one aggregate pass
(plus one statistic pass where bounds are needed)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelforge.operators.ordering import sample_n
from panelforge.spec import PanelSpec


def profile(df: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """Q1: rows, columns, key coverage, and one row per column with its type
    and non-NULL count -- one aggregate."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    if spec:
        aggs += [F.countDistinct(spec.entity).alias("__entities"), F.min(spec.year).alias("__ymin"),
                 F.max(spec.year).alias("__ymax")]
    wide = df.agg(*aggs)
    types = dict(df.dtypes)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                     F.col(f"`{c}`").alias("non_null"), F.col("__rows").alias("rows")) for c in df.columns]
    out = wide.select(F.explode(F.array(*rows)).alias("r"), *(["__entities", "__ymin", "__ymax"] if spec else []))
    return out.select("r.*", *([F.col("__entities").alias("entities"), F.col("__ymin").alias("min_year"),
                                F.col("__ymax").alias("max_year")] if spec else []))


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """Q2: missing count and percent per column, largest first."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing"),
                     (100.0 * F.col(f"`{c}`") / F.col("__n")).alias("missing_pct")) for c in cols]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if only_missing:
        out = out.where(F.col("missing") > 0)
    return out.orderBy(F.desc("missing"), "column")


def outlier_bounds(df: DataFrame, cols: Sequence[str], k: float = 3.0, approx: bool = False) -> dict:
    from panelforge.operators.order_stats import quantiles_by_column
    quart = quantiles_by_column(df, cols, [0.25, 0.75], "approx" if approx else "exact")
    out = {}
    for c in cols:
        q = quart[c]
        if q[0] is None:
            continue
        q1, q3 = float(q[0]), float(q[1])
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def outliers(df: DataFrame, cols: Sequence[str], k: float = 3.0, approx: bool = False) -> DataFrame:
    """Q3 / Q4: count of values outside ``[Q1 - k IQR, Q3 + k IQR]`` per
    column with the bounds (quartile pass, then one counting pass)."""
    b = outlier_bounds(df, cols, k, approx)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c, (_, _, lo, hi) in b.items():
        aggs.append(F.count_if((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).alias(c))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"),
                     F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), F.col(f"`{c}`").alias("n_outliers"),
                     (100.0 * F.col(f"`{c}`") / F.col("__n")).alias("pct"))
            for c, (q1, q3, lo, hi) in b.items()]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def outlier_rows(df: DataFrame, col: str, k: float = 1.5, approx: bool = False) -> DataFrame:
    """Q4: the rows outside the fences of one column."""
    b = outlier_bounds(df, [col], k, approx)
    if col not in b:
        return df.limit(0)
    _, _, lo, hi = b[col]
    return df.where((F.col(col) < F.lit(lo)) | (F.col(col) > F.lit(hi)))


def match_rate(df: DataFrame, col: str) -> DataFrame:
    """Q5: rows with a value after a left join, of all rows."""
    return df.agg(F.count(F.col(col)).alias("matched"), F.count(F.lit(1)).alias("rows"),
                  (F.count(F.col(col)) / F.count(F.lit(1))).alias("match_rate"))


def step_log(df: DataFrame, step, name: str = "step"):
    """Q6: rows before and after a step, counted in the same pass through
    ``DataFrame.observe`` (values are available after the first action)."""
    before, after = Observation(f"{name}_in"), Observation(f"{name}_out")
    out = step(df.observe(before, F.count(F.lit(1)).alias("rows")))
    out = out.observe(after, F.count(F.lit(1)).alias("rows"))

    def report() -> dict:
        b, a = before.get["rows"], after.get["rows"]
        return {"step": name, "rows_in": b, "rows_out": a, "removed": b - a}
    return out, report


class ExpectationError(AssertionError):
    pass


def expect(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, int]:
    """Q7: every rule must hold on every row; violations per rule are
    counted in one aggregate and raise together."""
    row = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()]).first()
    bad = {k: int(row[k]) for k in rules if row[k]}
    if bad:
        raise ExpectationError(f"expectations failed: {bad}")
    return {k: 0 for k in rules}


def expectation_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Q7 as a table: violations per rule, one aggregate, no raise."""
    wide = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()])
    rows = [F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("violations")) for k in rules]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def expect_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q11: keys only in ``a``, only in ``b`` (left anti both ways)."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    only_a = ka.join(kb, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("only_left"))
    only_b = kb.join(ka, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("only_right"))
    # two one-row aggregates side by side (constant-key equi join, no cross join)
    return only_a.withColumn("__k", F.lit(1)).join(only_b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def pair_sample(df: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Q12: reproducible sample of column pairs for scatter data."""
    return sample_n(df.select(*keys, *cols), keys, n, seed)
