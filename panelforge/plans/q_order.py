"""Order statistics on data that strains them: infinities, many decades, ties and a group that holds most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import order_stats as OS
from panelforge.operators import quality as QL
from panelforge.operators import windows as W
from panelforge.plans import panel as P
from panelforge.plans.q_fill import _MIDDLE, _TAIL
from panelforge.plans.registry import query


def R(c, n=4):
    return F.round(c, n)


# the price per unit above 20, with a price of nothing on one side and a division by nothing on the other
STRAINED = """WITH strained AS (
  SELECT CASE WHEN l_quantity = 20 THEN 'inf'::DOUBLE WHEN l_quantity = 1 THEN '-inf'::DOUBLE
              ELSE l_extendedprice / (l_quantity - 20) END AS ratio,
         l_extendedprice * pow(10::DOUBLE, l_quantity * 10 - 250) AS wide, l_returnflag, l_linenumber FROM lineitem)"""


def _strained(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    ratio = (F.when(q == 20, F.lit(float("inf"))).when(q == 1, F.lit(float("-inf")))
             .otherwise(F.col("l_extendedprice") / F.when(q != 20, q - 20)))
    wide = F.col("l_extendedprice") * F.pow(F.lit(10.0), q * 10 - 250)
    return li.select(ratio.alias("ratio"), wide.alias("wide"), "l_returnflag", "l_linenumber")


@query("a11_quantiles_with_infinities", ops=("A11", "A12", "P16"), sql=STRAINED + """,
q AS (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]) AS q)
SELECT CAST(q AS DOUBLE) AS q, (SELECT CASE WHEN isinf(v) THEN NULL ELSE round(v, 4) END FROM (
         SELECT quantile_cont(ratio, q) AS v FROM strained)) AS ratio,
       (SELECT CASE WHEN q IN (0.0, 1.0) THEN CAST(count(*) FILTER (WHERE isinf(ratio)) AS BIGINT) ELSE 0 END FROM strained) AS infinite
FROM q""".replace("quantile_cont(ratio, q)", """CASE q WHEN 0.0 THEN quantile_cont(ratio, 0.0) WHEN 0.05 THEN quantile_cont(ratio, 0.05)
         WHEN 0.25 THEN quantile_cont(ratio, 0.25) WHEN 0.5 THEN quantile_cont(ratio, 0.5) WHEN 0.75 THEN quantile_cont(ratio, 0.75)
         WHEN 0.95 THEN quantile_cont(ratio, 0.95) ELSE quantile_cont(ratio, 1.0) END"""))
def a_quantiles_infinite(spark, sf_dir):
    """Quantiles of a column with both infinities; the ends are infinite (shown as NULL, with the count of such rows)."""
    d = _strained(spark, sf_dir)
    infinite = d.agg(F.count_if(F.abs("ratio") == float("inf"))).first()[0]
    got = A.quantiles(d, "ratio", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])
    return got.select("q", F.when(F.abs("value") != float("inf"), R("value")).alias("ratio"),
                      F.when(F.col("q").isin(0.0, 1.0), F.lit(infinite)).otherwise(F.lit(0)).alias("infinite"))


@query("q03_outliers_with_infinities", ops=("Q3", "Q4"), sql=STRAINED + """,
q AS (SELECT quantile_cont(ratio, 0.25) AS a, quantile_cont(ratio, 0.75) AS b FROM strained)
SELECT 'ratio' AS "column", CAST(count(*) FILTER (WHERE ratio < a - 3 * (b - a) OR ratio > b + 3 * (b - a)) AS BIGINT) AS n_outliers,
       round(any_value(a - 3 * (b - a)), 4) AS lo, round(any_value(b + 3 * (b - a)), 4) AS hi FROM strained, q""")
def q_outliers_infinite(spark, sf_dir):
    out = QL.outliers(_strained(spark, sf_dir), ["ratio"], 3.0)
    return out.select("column", "n_outliers", R("lower").alias("lo"), R("upper").alias("hi"))


@query("a10_median_wide_decades_by_group", ops=("A10",), sql=STRAINED + """
SELECT l_linenumber, l_returnflag, CAST(median(wide) AS DOUBLE) AS wide, round(median(ratio), 4) AS ratio
FROM strained GROUP BY ALL""")
def a_median_wide(spark, sf_dir):
    """Medians of two columns by two keys at once; one column spans 500 decades."""
    d = A.median_by(_strained(spark, sf_dir), ["l_linenumber", "l_returnflag"], ["wide", "ratio"])
    return d.withColumn("ratio", R("ratio"))


@query("a11_value_ranks_under_ties", ops=("A11", "A29"), sql="""
SELECT l_returnflag, l_quantity, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) AS BIGINT) AS before
FROM lineitem GROUP BY 1, 2""")
def a_value_ranks(spark, sf_dir):
    """Distinct values with their rows and the rows below them, per return flag."""
    return OS.value_ranks(P.table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query("w17_qq_table_under_ties", ops=("W17",), sql=f"""
WITH s AS (SELECT l_quantity AS sample, row_number() OVER (ORDER BY l_quantity) AS i, count(*) OVER () AS n FROM lineitem),
u AS (SELECT i, sample, CASE WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n)
                             ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM s),
q AS (SELECT *, CAST(CASE WHEN p < 0.02425::DOUBLE THEN sqrt(-2 * ln(p)) WHEN p > 0.97575::DOUBLE THEN sqrt(-2 * ln(1 - p))
                          ELSE p - 0.5::DOUBLE END AS DOUBLE) AS q FROM u),
r AS (SELECT *, q * q AS r FROM q)
SELECT CAST(i AS BIGINT) AS i, CAST(sample AS DOUBLE) AS sample,
       round(CASE WHEN p < 0.02425::DOUBLE THEN {_TAIL} WHEN p > 0.97575::DOUBLE THEN -{_TAIL} ELSE {_MIDDLE} END, 6) AS theoretical
FROM r""")
def w_qq_ties(spark, sf_dir):
    """Q-Q positions of all rows of a column with 50 distinct values."""
    d = W.qq_table(P.table(spark, sf_dir, "lineitem"), "l_quantity")
    return d.select("i", F.col("sample").cast("double").alias("sample"), R("theoretical", 6).alias("theoretical"))
