"""Aggregations.

All statistics are one ``agg`` per pass over the data, with partial
(map-side) aggregation, so a key that holds a third of the rows is reduced
on every mapper before the shuffle. Exact quantiles come from
``order_stats`` (counts of value bins, for whole columns and for groups);
``approx=True`` switches to ``percentile_approx``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.order_stats import exact_quantiles, grouped_quantiles, quantiles_by_column
from panelforge.spec import PanelSpec


def _pct(col: str | Column, q, approx: bool = False, accuracy: int = 10000) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if approx:
        return F.percentile_approx(c, q, accuracy)
    return F.percentile(c, q)


def sum_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], names: Sequence[str] | None = None,
           zero_for_empty: bool = True) -> DataFrame:
    """A1: sum by keys; NULL keys dropped (pandas groupby rule); an
    all-NULL group sums to 0 like pandas when ``zero_for_empty``."""
    names = names or cols
    d = df.dropna(subset=list(keys))
    aggs = [(F.coalesce(F.sum(c), F.lit(0)) if zero_for_empty else F.sum(c)).alias(n)
            for c, n in zip(cols, names)]
    return d.groupBy(*keys).agg(*aggs)


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """A2: mean of many columns in one aggregate."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.avg(c).alias(c + suffix) for c in cols])


def to_yearly(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """A3: monthly rows to the yearly mean per entity."""
    return mean_by(df, [spec.entity, spec.year], cols)


def yearly_summary(df: DataFrame, by: str | Sequence[str], col: str) -> DataFrame:
    """A4: mean, sample std, count, sum by year."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                               F.count(col).alias("count"), F.sum(col).alias("sum"))


def first_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str | Column) -> DataFrame:
    """A5: first non-NULL value per key and column in ``order``.
    ``min_by`` skips rows whose ordering is NULL, so ordering is nulled
    where the value is NULL."""
    o = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c)
                                   for c in cols])


def inconsistent_groups(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Groups where ``col`` takes more than one distinct value."""
    return (df.groupBy(*keys).agg(F.countDistinct(col).alias("n_distinct"))
            .filter(F.col("n_distinct") > 1))


def coverage(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct entities, time range, rows."""
    return df.agg(F.countDistinct(spec.entity).alias("n_entities"), F.min(spec.year).alias("min_year"),
                  F.max(spec.year).alias("max_year"), F.count(F.lit(1)).alias("n_rows"))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def mean_group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return group_sizes(df, keys).agg(F.avg("n").alias("mean_size"), F.count(F.lit(1)).alias("n_groups"))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Counts per value; with ``normalize`` the share of all rows.
    The total is one scalar aggregate applied as a literal (no global window)."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = df.count()
        out = out.withColumn("share", F.col("count") / F.lit(float(total) if total else None))
    return out


def median_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], method: str = "exact") -> DataFrame:
    """A10: median by keys (``keys=[]`` for the overall median), NULL for a group without values.
    ``exact`` counts value bins (``grouped_quantiles``, ``quantiles_by_column``), however the rows are spread over
    the groups; ``percentile`` holds a value map per group and ``approx`` a sketch."""
    keys, cols = list(keys), list(cols)
    if method != "exact":
        return df.groupBy(*keys).agg(*[_pct(c, 0.5, method == "approx").alias(c) for c in cols])
    if not keys:
        medians = quantiles_by_column(df, cols, [0.5])
        return df.sparkSession.range(1).select(*[F.lit(medians[c][0]).cast("double").alias(c) for c in cols])
    names = {k: f"__{k}" for k in keys}
    medians = grouped_quantiles(df, keys, cols, [0.5], cols).withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(m)) for k, m in names.items()]
    return df.select(*keys).distinct().join(medians, on, "left").select(*keys, *cols)


def quantiles(df: DataFrame, col: str, qs: Sequence[float], approx: bool = False) -> DataFrame:
    """Quantiles of one column as (q, value) rows (exact;
    ``approx=True`` for a sketch)."""
    vals = exact_quantiles(df, col, qs, "approx" if approx else "exact")
    return df.sparkSession.createDataFrame([(float(q), v) for q, v in zip(qs, vals)], "q double, value double")


DESCRIBE_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe_numeric(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Count, mean, std (ddof=1), min, quartiles, max in long layout
    (column, statistic, value): the moments in one aggregate, the quartiles
    of all columns together by ``quantiles_by_column``."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).cast("double").alias(f"{c}|count"), F.avg(c).alias(f"{c}|mean"),
                 F.stddev_samp(c).alias(f"{c}|std"), F.min(c).cast("double").alias(f"{c}|min"),
                 F.max(c).cast("double").alias(f"{c}|max")]
    row = df.agg(*aggs).first()
    quart = quantiles_by_column(df, cols, [0.25, 0.5, 0.75], "approx" if approx else "exact")
    out = []
    for c in cols:
        q = quart[c]
        vals = {"count": row[f"{c}|count"], "mean": row[f"{c}|mean"], "std": row[f"{c}|std"],
                "min": row[f"{c}|min"], "25%": q[0], "50%": q[1], "75%": q[2], "max": row[f"{c}|max"]}
        out += [(c, s, None if vals[s] is None else float(vals[s])) for s in DESCRIBE_STATS]
    return df.sparkSession.createDataFrame(out, "column string, statistic string, value double")


def skew_kurt(df: DataFrame, cols: Sequence[str], bias: bool = False,
              by: Sequence[str] = ()) -> DataFrame:
    """Skewness and excess kurtosis per column.

    Spark gives the biased g1, g2; ``bias=False`` converts to pandas'
    adjusted G1 = g1 sqrt(n(n-1))/(n-2) and
    G2 = ((n+1) g2 + 6)(n-1)/((n-2)(n-3))."""
    aggs = []
    for c in cols:
        aggs += [F.skewness(c).alias(f"{c}|s"), F.kurtosis(c).alias(f"{c}|k"),
                 F.count(c).cast("double").alias(f"{c}|n")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = []
    for c in cols:
        g1, g2, n = F.col(f"`{c}|s`"), F.col(f"`{c}|k`"), F.col(f"`{c}|n`")
        if bias:
            sk, ku = g1, g2
        else:
            sk = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
            ku = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
        rows.append(F.struct(F.lit(c).alias("column"), sk.alias("skewness"), ku.alias("kurtosis")))
    return wide.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, pairwise complete
    (``corr`` skips rows where either side is NULL), in one aggregate; long
    layout (a, b, corr) including the diagonal and both orders."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = []
    for a, b in pairs:
        x = F.when(F.col(b).isNotNull(), F.col(a))
        y = F.when(F.col(a).isNotNull(), F.col(b))
        aggs.append(F.corr(x, y).alias(f"{a}|{b}"))
    wide = df.agg(*aggs)
    structs = []
    for a, b in pairs:
        v = F.col(f"`{a}|{b}`")
        structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("corr")))
        if a != b:
            structs.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), v.alias("corr")))
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def target_corr(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of each column with the target, as rows."""
    wide = df.agg(*[F.corr(F.col(c), F.col(target)).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("corr")) for c in cols])).alias("r")).select("r.*")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin is closed
    on both sides (numpy rule). Every bin is returned, empty ones with 0."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint")
    lo, hi = float(lo), float(hi)
    if lo == hi:  # numpy widens a degenerate range by 0.5 on each side
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("int") + 1, F.lit(1)),
                F.lit(bins))
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                         (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"))
    return edges.join(counts, "bin", "left").fillna({"count": 0})


def pivot_mean(df: DataFrame, row: str, col: str, value: str, values: Sequence | None = None) -> DataFrame:
    """Mean of ``value`` in a row x col grid. Passing ``values`` avoids
    the extra distinct job Spark otherwise runs to find pivot columns."""
    g = df.groupBy(row)
    p = g.pivot(col, list(values)) if values is not None else g.pivot(col)
    return p.agg(F.avg(value))


def pivot_first(df: DataFrame, row: Sequence[str], col: str, value: str,
                values: Sequence | None = None) -> DataFrame:
    """The non-NULL value of each grid cell; where a cell has several,
    the largest, so the result does not depend on row order."""
    g = df.groupBy(*row)
    p = g.pivot(col, list(values)) if values is not None else g.pivot(col)
    return p.agg(F.max(value))


def pivot_items(df: DataFrame, keys: Sequence[str], item_col: str, value: str,
                items: Sequence[tuple[str, str]]) -> DataFrame:
    """A19 (item form) / J7 alternative: one conditional aggregate per item
    instead of a chain of outer joins -- one shuffle for any number of items."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(item_col) == F.lit(it), F.col(value))).alias(name)
                                   for it, name in items])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable",
         value: str = "value", cast: str | None = None, dropna: bool = False) -> DataFrame:
    """Wide to long with optional cast and NULL drop."""
    d = df.select(*ids, *[F.col(c).cast(cast).alias(c) if cast else F.col(c) for c in values])
    out = d.unpivot(list(ids), list(values), var, value)
    return out.dropna(subset=[value]) if dropna else out


def distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A21."""
    return df.select(*cols).distinct()


def arg_extreme(df: DataFrame, key: str, val: str, by: Sequence[str] = ()) -> DataFrame:
    """Key of the largest and smallest value (ties: smallest key)."""
    mx = F.max_by(F.col(key), F.struct(F.col(val), -F.col(key).cast("double")))
    mn = F.min_by(F.col(key), F.struct(F.col(val), F.col(key)))
    aggs = [mx.alias("argmax"), mn.alias("argmin"), F.max(val).alias("max"), F.min(val).alias("min")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def mode(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; ties give the smallest value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v")))["v"].alias("mode")
    return counts.groupBy(*by).agg(best) if by else counts.agg(best)


def entity_totals(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    """Sum per (entity, year), then per entity."""
    ey = df.groupBy(spec.entity, spec.year).agg(F.sum(col).alias("year_total"))
    return ey.groupBy(spec.entity).agg(F.sum("year_total").alias("total"),
                                       F.count(F.lit(1)).alias("n_years"))


def annualize(df: DataFrame, keys: Sequence[str], cols: Sequence[str], mode: str = "mean") -> DataFrame:
    """Predictions and actuals to one value per key, all models in one
    aggregate. ``mode='sum'`` reproduces the reference's monthly sum of an
    annual value copied onto every month (7x); ``mean`` and ``first`` (the
    smallest, where copies differ) give the annual value itself."""
    fn = {"sum": F.sum, "mean": F.avg, "first": F.min}[mode]
    return df.groupBy(*keys).agg(*[fn(c).alias(c) for c in cols])


def total_error(df: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """Grand totals and signed percent error per model."""
    wide = df.agg(F.sum(actual).alias("__a"), *[F.sum(m).alias(m) for m in models])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col("__a").alias("actual_total"), F.col(m).alias("pred_total"),
                 (100 * F.try_divide(F.col(m) - F.col("__a"), F.col("__a"))).alias("pct_error"))
        for m in models])).alias("r")).select("r.*")


def top_variance(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Columns with the largest sample variance."""
    wide = df.agg(*[F.var_samp(c).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("variance")) for c in cols])).alias("r")).select("r.*")
    return long.orderBy(F.desc("variance"), "column").limit(n)


def count_if(df: DataFrame, cond: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of rows meeting a condition."""
    aggs = [F.count_if(cond).alias("n_true"), F.count(F.lit(1)).alias("n"),
            (F.count_if(cond) / F.count(F.lit(1))).alias("share")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def sorted_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values in order, as rows (a distributed sort, not an
    array collected into one task)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def rank_means(df: DataFrame, key: str, col: str, ascending: bool = False) -> DataFrame:
    """Mean per key, sorted."""
    g = df.groupBy(key).agg(F.avg(col).alias("mean"))
    return g.orderBy(F.col("mean").asc() if ascending else F.col("mean").desc(), key)


def cv_summary(df: DataFrame, metric_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population spread of metrics over folds."""
    aggs = []
    for c in metric_cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def collect_ordered(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
                    out: str = "sequence") -> DataFrame:
    """Rows of a group to an array sorted by ``order``. Only for groups
    of bounded size (months of a year: at most 12 elements)."""
    st = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(st)).alias(out))


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), whisker: float = 1.5,
              approx: bool = False) -> DataFrame:
    """Quartiles, whiskers at the most extreme values inside
    ``Q1 - k IQR`` / ``Q3 + k IQR``, and the number of points outside."""
    by = list(by)
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if by and not approx:
        qs = grouped_quantiles(df, by, col, list(quarters.values()), list(quarters))
    elif by:
        q = F.percentile_approx(col, list(quarters.values()), 10000)
        qs = df.groupBy(*by).agg(q.alias("__q")).select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(quarters)])
    else:
        got = exact_quantiles(df, col, list(quarters.values()), "approx" if approx else "exact")
        qs = df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in zip(quarters, got)])
    qs = qs.withColumn("lo_fence", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))) \
           .withColumn("hi_fence", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    if by:
        joined = df.join(qs, on=by, how="inner")
    else:  # one-row statistics: constant-key equi join with the proven one-row side broadcast
        joined = df.withColumn("__k", F.lit(1)).join(F.broadcast(qs.withColumn("__k", F.lit(1))), "__k").drop("__k")
    inside = (F.col(col) >= F.col("lo_fence")) & (F.col(col) <= F.col("hi_fence"))
    return joined.groupBy(*by, "q1", "median", "q3", "lo_fence", "hi_fence").agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
        F.count_if(F.col(col).isNotNull() & ~inside).alias("n_outliers"))


def gram(df: DataFrame, cols: Sequence[str], y: str | None = None) -> dict:
    """Z'Z, Z'y, y'y and n in one aggregate (m(m+1)/2 + m + 2 sums).
    The result is an m x m matrix -- bounded by the column count."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}"))
        if y:
            aggs.append(F.sum(F.col(a) * F.col(y)).alias(f"{a}|__y"))
    if y:
        aggs.append(F.sum(F.col(y) * F.col(y)).alias("__yy"))
    row = df.agg(*aggs).first().asDict()
    m = len(cols)
    zz = [[0.0] * m for _ in range(m)]
    for i, a in enumerate(cols):
        for j in range(i, m):
            v = float(row[f"{a}|{cols[j]}"] or 0.0)
            zz[i][j] = zz[j][i] = v
    out = {"n": row["n"], "ZtZ": zz}
    if y:
        out["Zty"] = [float(row[f"{a}|__y"] or 0.0) for a in cols]
        out["yty"] = float(row["__yy"] or 0.0)
    return out


def gram_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A34 as a DataFrame (a, b, sum_ab) for reporting."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("sum_ab"))
        for a, b in pairs])).alias("r")).select("r.*")


def kde(df: DataFrame, col: str, points: int = 50, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an evenly spaced grid over [min, max].

    Bandwidth defaults to Scott's rule (n^-1/5 times the sample std), as the
    SciPy estimator does. One aggregate holds a sum per grid point, so rows
    are never multiplied and each task sends ``points`` partial sums."""
    st = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"), F.min(col).alias("lo"),
                F.max(col).alias("hi")).first()
    n, sd, lo, hi = st["n"], st["sd"], st["lo"], st["hi"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "i int, x double, density double")
    h = bandwidth or sd * n ** (-1.0 / 5.0)
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    at = [float(lo + i * step) for i in range(points)]
    wide = df.agg(*[(F.sum(F.exp(-0.5 * F.pow((F.lit(g) - F.col(col)) / F.lit(h), 2))) * F.lit(norm)).alias(f"g{i}")
                    for i, g in enumerate(at)])
    long = wide.select(F.posexplode(F.array(*[F.col(f"g{i}") for i in range(points)])).alias("i", "density"))
    return long.select("i", (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"), "density")
