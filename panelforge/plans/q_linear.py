"""Linear fits from additive fold sums (M21, M29, M37, M39) and principal components (M13-M16), each
with a DuckDB twin that sums the same products and solves the systems by elimination
(fits) or by repeated squaring (components)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import evaluate as V
from panelforge.operators import features as E
from panelforge.operators import linear as LN
from panelforge.operators import mlprep as MP
from panelforge.operators import models as M
from panelforge.operators import windows as W
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query

COLS = ["v", "n", "mo"]
LABEL = "log_total"
DEGREES, ALPHAS, FOLDS = (1, 2, 3), (0.1, 1.0, 10.0), 5


def R(c, n=6):
    return F.round(c, n)


def _panel(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).withColumn(LABEL, F.log1p("total"))
    return MP.temporal_split(p, "yr", 2000)


# ---------------------------------------------------------------- SQL of the twins
def scaled_sql(source: str, cols: list[str], fitted_on: str, more: str) -> str:
    """The columns scaled by mean and population deviation of ``fitted_on``."""
    each = ", ".join(f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in cols)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    return f"SELECT {each}, {more} FROM {source}, (SELECT {stats} FROM {fitted_on})"


def product(term) -> str:
    return " * ".join(term) if term else "1.0::DOUBLE"


def gram_sql(terms: list, source: str, by: str = "", weight: str = "1.0::DOUBLE", label: str = "y") -> str:
    """``G``: the sums of products of all terms and the label, as a list of lists, per ``by``."""
    every = [product(t) for t in terms] + [label]
    sums = {(i, j): f"g{i}_{j}" for i in range(len(every)) for j in range(i, len(every))}
    rows = ", ".join("[" + ", ".join(sums[min(i, j), max(i, j)] for j in range(len(every))) + "]" for i in range(len(every)))
    parts = ", ".join(f"sum({weight} * {every[i]} * {every[j]}) AS {name}" for (i, j), name in sums.items())
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {key}[{rows}] AS G FROM (SELECT {key}{parts} FROM {source}{group})"


#: Elimination on ``systems(id, k, m)``, where ``m`` has the right side as last column; gives ``solutions(id, b)``.
SOLVE_SQL = """
elim AS (SELECT id, 1::BIGINT AS step, m FROM systems UNION ALL
  SELECT id, step + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 2), lambda j:
    CASE WHEN i = step THEN m[step][j] / m[step][step] ELSE m[i][j] - m[i][step] * m[step][j] / m[step][step] END))
  FROM elim WHERE step <= len(m)),
solutions AS (SELECT id, list_transform(m, lambda r: r[len(r)]) AS b FROM elim WHERE step > len(m))"""


def system_sql(total: str, without: str, size: str, last: int, alpha: str) -> str:
    """The matrix of a training system: the total less a fold, a penalty on the diagonal but for the intercept."""
    less = f" - {without}[i][j]" if without else ""
    right = f" - {without}[i][{last}]" if without else ""
    return (f"list_transform(range(1, {size} + 1), lambda i: list_append(list_transform(range(1, {size} + 1), lambda j: "
            f"{total}[i][j]{less} + CASE WHEN i = j AND i > 1 THEN {alpha} ELSE 0.0 END), {total}[i][{last}]{right}))")


TERMS = LN.monomials(COLS, max(DEGREES))
SIZES = {d: len(LN.monomials(COLS, d)) for d in DEGREES}
LAST = len(TERMS) + 1
def search_sql(settings: str) -> str:
    """``scores`` of all ``settings(degree, size, alpha)`` by folds, ``best``, and in ``solutions`` the fits on all rows (id -1)."""
    return "WITH RECURSIVE " + Q.PANEL + f""",
train AS (SELECT * FROM panel WHERE yr < 2000),
folded AS (SELECT *, (row_number() OVER (ORDER BY md5('42|' || entity || '|' || yr || '|' || mo), entity, yr, mo) - 1) % {FOLDS} AS fold FROM train),
z AS ({scaled_sql('folded', COLS, 'train', 'ln(1 + total) AS y, fold')}),
folds AS ({gram_sql(TERMS, 'z', 'fold')}),
whole AS ({gram_sql(TERMS, 'z')}),
settings AS ({settings}),
systems AS (
  SELECT [fold, degree, alpha]::DOUBLE[] AS id, {system_sql('w.G', 'f.G', 'size', LAST, 'alpha')} AS m FROM folds f, whole w, settings
  UNION ALL SELECT [-1, degree, alpha]::DOUBLE[], {system_sql('w.G', '', 'size', LAST, 'alpha')} FROM whole w, settings),
{SOLVE_SQL},
errors AS (
  SELECT id[2] AS degree, id[3] AS alpha, G[1][1] AS n, G[{LAST}][{LAST}] - G[1][{LAST}] * G[1][{LAST}] / G[1][1] AS spread,
         G[{LAST}][{LAST}] - 2 * list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * G[i][{LAST}]))
         + list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * list_sum(list_transform(range(1, len(b) + 1), lambda j: G[i][j] * b[j])))) AS sse
  FROM solutions JOIN folds ON fold = id[1]),
scores AS (SELECT CAST(degree AS BIGINT) AS degree, alpha, avg(1 - sse / spread) AS mean_r2, stddev_pop(1 - sse / spread) AS std_r2,
                  avg(sqrt(sse / n)) AS mean_rmse FROM errors GROUP BY 1, 2),
best AS (SELECT * FROM scores ORDER BY mean_r2 DESC, degree, alpha DESC LIMIT 1)"""


def grid_sql(degrees, alphas) -> str:
    sizes = ", ".join(f"({d}, {SIZES[d]})" for d in degrees)
    return f"SELECT * FROM (VALUES {sizes}) AS d(degree, size), (VALUES {', '.join(f'({a}::DOUBLE)' for a in alphas)}) AS a(alpha)"


SEARCH_SQL = search_sql(grid_sql(DEGREES, ALPHAS))


def _search(spark, sf_dir):
    train, test = _panel(spark, sf_dir)
    folded = MP.kfold(train, ["entity", "yr", "mo"], k=FOLDS, seed=42)
    return *LN.ridge_search(folded, COLS, LABEL, DEGREES, ALPHAS), test


@query("m21_ridge_search_table", ops=("M21", "M10", "V15", "M25"), sql=SEARCH_SQL + """
SELECT degree, alpha, round(mean_r2, 6) AS mean_r2, round(std_r2, 6) AS std_r2, round(mean_rmse, 6) AS mean_rmse,
       CAST((degree, alpha) = (SELECT (degree, alpha) FROM best) AS BIGINT) AS chosen FROM scores""")
def m_ridge_table(spark, sf_dir):
    """All degrees and penalties by five folds, from one pass over the training rows."""
    fit, table, _ = _search(spark, sf_dir)
    chosen = (fit.info["degree"], fit.info["alpha"])
    rows = [(r["degree"], r["alpha"], round(r["mean_r2"], 6), round(r["std_r2"], 6), round(r["mean_rmse"], 6),
             (r["degree"], r["alpha"]) == chosen) for r in table]
    return spark.createDataFrame(rows, "degree int, alpha double, mean_r2 double, std_r2 double, mean_rmse double, chosen boolean")


def _predicted(terms, b="b") -> str:
    return " + ".join(f"coalesce({b}[{i + 1}], 0) * {product(t)}" for i, t in enumerate(terms))


def metrics_sql(source: str) -> str:
    """Errors on the original scale (expm1) and R2 on the log scale of ``p`` against ``y``."""
    return f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(pow(exp(y) - exp(p), 2))), 2) AS rmse, round(avg(abs(exp(y) - exp(p))), 2) AS mae,
       round(1 - sum(pow(exp(y) - exp(p), 2)) / (count(*) * var_pop(exp(y))), 6) AS r2,
       round(1 - sum(pow(y - p, 2)) / (count(*) * var_pop(y)), 6) AS r2_log"""


def _metrics(scored):
    back = scored.select(F.expm1(LABEL).alias("y"), F.expm1("prediction").alias("p"))
    logs = V.metrics(scored, LABEL, "prediction", eps=None).select(F.col("r2").alias("r2_log"))
    return W._attach_row(V.metrics(back, "y", "p", eps=1e-8), logs).select(
        "n", R("rmse", 2).alias("rmse"), R("mae", 2).alias("mae"), R("r2").alias("r2"), R("r2_log").alias("r2_log"))


@query("m21_ridge_polynomial_degree", ops=("M21", "M19", "V1", "V4"), sql=SEARCH_SQL + f""",
zt AS ({scaled_sql('panel', COLS, 'train', 'ln(1 + total) AS y, yr')}),
p AS (SELECT y, {_predicted(TERMS)} AS p, degree, alpha FROM zt, best, solutions WHERE yr >= 2000 AND id = [-1, degree, alpha]::DOUBLE[])
{metrics_sql('p')}, any_value(degree) AS degree, any_value(alpha) AS alpha FROM p""")
def m_ridge(spark, sf_dir):
    """The setting with the best cross-validated R2, fitted on all training rows and scored on the test years."""
    fit, _, test = _search(spark, sf_dir)
    return _metrics(fit.predict(test)).withColumns({"degree": F.lit(fit.info["degree"]), "alpha": F.lit(fit.info["alpha"])})


LINEAR = ["v", "n", "mo", "yr"]
LINEAR_TERMS = LN.monomials(LINEAR, 1)


def fit_sql(alpha: float, weight: str = "1.0::DOUBLE", more: str = "") -> str:
    """One ridge fit on the scaled training rows; ``solutions`` has its coefficients."""
    return "WITH RECURSIVE " + Q.PANEL + f""",
train AS (SELECT * FROM panel WHERE yr < 2000),
z AS ({scaled_sql('train', LINEAR, 'train', 'ln(1 + total) AS y, n AS raw_n')}{more}),
whole AS ({gram_sql(LINEAR_TERMS, 'z', weight=weight)}),
systems AS (SELECT 1 AS id, {system_sql('G', '', str(len(LINEAR_TERMS)), len(LINEAR_TERMS) + 1, f'{alpha}::DOUBLE')} AS m FROM whole),
{SOLVE_SQL}"""


@query("m29_coefficient_importance", ops=("M29",), sql=fit_sql(0.01) + f""",
c AS (SELECT unnest({LINEAR!r}) AS feature, abs(unnest(b[2:])) AS c FROM solutions)
SELECT feature, round(c, 6) AS abs_coef, round(100 * c / sum(c) OVER (), 4) AS pct FROM c""")
def m_coef(spark, sf_dir):
    train, _ = _panel(spark, sf_dir)
    shares = LN.coefficient_shares(LN.fit_ridge(train, LINEAR, LABEL, 1, 0.01), spark)
    return shares.select("feature", R("abs_coef").alias("abs_coef"), R("pct", 4).alias("pct"))


@query("m37_weighted_linear_fit", ops=("M37", "E24"), sql=fit_sql(1.0, "(1.0 / (raw_n + 1) / wm)", ", (SELECT avg(1.0 / (n + 1)) AS wm FROM train)").replace(
    ", n AS raw_n", ", n AS raw_n, wm") + f""",
zt AS ({scaled_sql('panel', LINEAR, 'train', 'ln(1 + total) AS y, yr AS year')}),
p AS (SELECT y, {_predicted(LINEAR_TERMS)} AS p FROM zt, solutions WHERE year >= 2000)
{metrics_sql('p')} FROM p""")
def m_weighted_linear(spark, sf_dir):
    """Rows weighted by the inverse of their order count, mean 1."""
    train, test = _panel(spark, sf_dir)
    weighted = E.inverse_weight(train, "n")
    return _metrics(LN.fit_ridge(weighted, LINEAR, LABEL, 1, 1.0, weight="sample_weight").predict(test))


# ---------------------------------------------------------------- principal components
PCA_COLS = ["v", "total", "n", "mo"]


def pca_sql(k: int) -> str:
    """Largest ``k`` eigenpairs of the correlation matrix: a matrix squared and scaled again and again tends
    to the projector on its first eigenvector; taking that part away leaves the next."""
    m = len(PCA_COLS)
    cells = ", ".join("[" + ", ".join(f"avg({a} * {b})" for b in PCA_COLS) + "]" for a in PCA_COLS)
    span = f"range(1, {m + 1})"
    parts = [f"z AS ({scaled_sql('panel', PCA_COLS, 'panel', 'entity, yr, mo AS month, total AS raw_total')})",
             f"c1 AS (SELECT [{cells}]::DOUBLE[][] AS a FROM z)"]
    for i in range(1, k + 1):
        parts.append(f"""
s{i} AS (SELECT 0 AS step, a AS p FROM c{i} UNION ALL
  SELECT step + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / t)) FROM (
    SELECT step, q, list_sum(list_transform({span}, lambda i: q[i][i])) AS t FROM (
      SELECT step, list_transform({span}, lambda i: list_transform({span}, lambda j:
        list_sum(list_transform({span}, lambda l: p[i][l] * p[l][j])))) AS q FROM s{i} WHERE step < 40))),
e{i} AS (SELECT p, list_sum(list_transform({span}, lambda i: list_sum(list_transform({span}, lambda j: a[i][j] * p[i][j])))) AS value, a,
                list_transform({span}, lambda i: p[i][list_position(d, list_max(d))] / sqrt(list_max(d))) AS raw
         FROM (SELECT *, list_transform({span}, lambda i: p[i][i]) AS d FROM s{i}, c{i} WHERE step = 40)),
v{i} AS (SELECT value, list_transform(raw, lambda x: x * sign(raw[list_position(list_transform(raw, lambda y: abs(y)),
         list_max(list_transform(raw, lambda y: abs(y))))])) AS w FROM e{i}),
c{i + 1} AS (SELECT list_transform({span}, lambda i: list_transform({span}, lambda j: a[i][j] - value * p[i][j])) AS a FROM e{i})""")
    return "WITH RECURSIVE " + Q.PANEL + ",\n" + ",\n".join(parts)


def _score(i: int) -> str:
    return " + ".join(f"v{i}.w[{j + 1}] * z.{c}" for j, c in enumerate(PCA_COLS))


@query("m13_m16_pca_scores", ops=("M13", "M16", "M2"), sql=pca_sql(2) + f"""
SELECT entity, yr, month AS mo, raw_total AS total, round({_score(1)}, 6) AS pc1, round({_score(2)}, 6) AS pc2 FROM z, v1, v2""")
def m_pca_scores(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    keep = p.withColumns({"raw_total": F.col("total"), "month": F.col("mo")})
    s = M.pca(p, PCA_COLS, k=2).scores(keep, keep=["entity", "yr", "month", "raw_total"])
    return s.select("entity", "yr", F.col("month").alias("mo"), F.col("raw_total").alias("total"), R("pc1").alias("pc1"), R("pc2").alias("pc2"))


_VALUES = " UNION ALL ".join(f"SELECT {i} AS component, value FROM v{i}" for i in range(1, len(PCA_COLS) + 1))


@query("m14_w16_pca_variance_report", ops=("M14", "W16"), sql=pca_sql(len(PCA_COLS)) + f""",
var AS (SELECT CAST(component AS BIGINT) AS component, value / {len(PCA_COLS)}.0 AS r FROM ({_VALUES})),
cum AS (SELECT *, sum(r) OVER (ORDER BY component) AS c FROM var)
SELECT component, round(r, 6) AS variance_ratio, (SELECT min(component) FROM cum WHERE c >= 0.9) AS n_for_90,
       (SELECT min(component) FROM cum WHERE c >= 0.95) AS n_for_95 FROM var""")
def m_pca_report(spark, sf_dir):
    res = M.pca(P.base_panel(spark, sf_dir), PCA_COLS, k=len(PCA_COLS))
    var = res.variance_df(spark)
    thr = W.components_for(var, "component", "variance_ratio")
    return W._attach_row(var.withColumn("variance_ratio", R("variance_ratio")), thr)


_LOADINGS = " UNION ALL ".join(f"SELECT {i} AS component, unnest({PCA_COLS!r}) AS feature, unnest(w) AS w FROM v{i}" for i in (1, 2))


@query("m15_pca_top_loadings", ops=("M15",), sql=pca_sql(2) + f"""
SELECT CAST(component AS BIGINT) AS component, feature, round(w, 6) AS loading, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(w) DESC, feature) AS rank FROM ({_LOADINGS})) WHERE rank <= 2""")
def m_pca_loadings(spark, sf_dir):
    res = M.pca(P.base_panel(spark, sf_dir), PCA_COLS, k=2)
    return M.pca_loadings(res, spark, n=2).withColumn("loading", R("loading"))
