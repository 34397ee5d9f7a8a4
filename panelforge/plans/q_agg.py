"""Aggregation (A*) and ordering / top-k (O*) queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.operators import aggregates as A
from panelforge.operators import joins as J
from panelforge.operators import ordering as O
from panelforge.operators import windows as W
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def R(c, n=4):
    return F.round(c, n)


def _parsed_survey(spark, sf_dir):
    s = P.survey_text(spark, sf_dir)
    return s.select(F.col("county_code").try_cast("double").cast("bigint").alias("entity"), "yr", "item",
                    S.parse_number("value_text").alias("v"))


PARSED_SQL = """parsed AS (SELECT CAST(try_cast(county_code AS DOUBLE) AS BIGINT) AS entity, yr, item,
                    try_cast(replace(value_text, ',', '') AS DOUBLE) AS v FROM survey)"""


@query("a01_sum_by_keys", ops=("A1",), sql=Q.with_(Q.SURVEY, PARSED_SQL) + """
SELECT entity, yr, item, round(coalesce(sum(v), 0), 2) AS total FROM parsed GROUP BY 1, 2, 3""")
def a_sum_by(spark, sf_dir):
    d = _parsed_survey(spark, sf_dir)
    return A.sum_by(d, ["entity", "yr", "item"], ["v"], ["total"]).withColumn("total", R("total", 2))


@query("a02_mean_of_many_columns", ops=("A2",), sql="""
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2""")
def a_mean_by(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    d = A.mean_by(li, ["l_returnflag", "l_linestatus"], LI_COLS)
    return d.select("l_returnflag", "l_linestatus", *[R(c, 6).alias(c) for c in LI_COLS])


@query("a03_monthly_to_yearly", ops=("A3",), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, round(avg(v), 6) AS v, round(avg(total), 6) AS total FROM panel GROUP BY 1, 2""")
def a_to_yearly(spark, sf_dir):
    d = A.to_yearly(P.base_panel(spark, sf_dir), P.PANEL, ["v", "total"])
    return d.select("entity", "yr", R("v", 6).alias("v"), R("total", 6).alias("total"))


@query("a04_yearly_summary", ops=("A4",), sql=Q.with_(Q.PANEL) + """
SELECT yr, round(avg(total), 4) AS mean, round(stddev_samp(total), 4) AS std, CAST(count(total) AS BIGINT) AS count,
       round(sum(total), 2) AS sum FROM panel GROUP BY yr""")
def a_yearly_summary(spark, sf_dir):
    d = A.yearly_summary(P.base_panel(spark, sf_dir), "yr", "total")
    return d.select("yr", R("mean").alias("mean"), R("std").alias("std"), "count", R("sum", 2).alias("sum"))


@query("a05_first_non_null_per_key", ops=("A5",), sql=Q.with_(Q.SPARSE) + """
SELECT entity, round(arg_min(item, yr) FILTER (WHERE item IS NOT NULL), 4) AS item,
       arg_min(yr, yr) FILTER (WHERE item IS NOT NULL) AS first_year FROM sparse GROUP BY entity""")
def a_first_by(spark, sf_dir):
    s = P.sparse_item(spark, sf_dir).withColumn("first_year", F.when(F.col("item").isNotNull(), F.col("yr")))
    d = A.first_by(s, ["entity"], ["item", "first_year"], "yr")
    return d.select("entity", R("item").alias("item"), "first_year")


@query("a06_q08_inconsistent_groups", ops=("A6", "Q8"), sql="""
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr,
       CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_distinct
FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1""")
def a_inconsistent(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate"))
    return A.inconsistent_groups(o, ["o_custkey", "yr"], "o_orderstatus")


@query("a07_coverage", ops=("A7",), sql=Q.with_(Q.PANEL) + """
SELECT CAST(count(DISTINCT entity) AS BIGINT) AS n_entities, min(yr) AS min_year, max(yr) AS max_year,
       CAST(count(*) AS BIGINT) AS n_rows FROM panel""")
def a_coverage(spark, sf_dir):
    return A.coverage(P.base_panel(spark, sf_dir), P.PANEL)


@query("a08_group_sizes", ops=("A8",), sql="""
SELECT round(avg(n), 6) AS mean_size, CAST(count(*) AS BIGINT) AS n_groups
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def a_group_sizes(spark, sf_dir):
    d = A.mean_group_size(P.table(spark, sf_dir, "orders"), ["o_custkey"])
    return d.select(R("mean_size", 6).alias("mean_size"), "n_groups")


@query("a09_value_counts_share", ops=("A9", "A28"), sql="""
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count, round(count(*) / (SELECT count(*) FROM orders), 6) AS share
FROM orders GROUP BY 1""")
def a_value_counts(spark, sf_dir):
    d = A.value_counts(P.table(spark, sf_dir, "orders"), "o_orderpriority", normalize=True)
    return d.withColumn("share", R("share", 6))


@query("a10_median_by_entity_year_overall", ops=("A10",), sql=Q.with_(Q.PANEL) + """
SELECT 'entity' AS level, entity AS k, round(median(total), 4) AS median FROM panel GROUP BY entity
UNION ALL SELECT 'year', yr, round(median(total), 4) FROM panel GROUP BY yr
UNION ALL SELECT 'overall', CAST(-1 AS BIGINT), round(median(total), 4) FROM panel""")
def a_median_by(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    e = A.median_by(p, ["entity"], ["total"]).select(F.lit("entity").alias("level"), F.col("entity").alias("k"), "total")
    y = A.median_by(p, ["yr"], ["total"]).select(F.lit("year").alias("level"), F.col("yr").alias("k"), "total")
    o = A.median_by(p, [], ["total"]).select(F.lit("overall").alias("level"), F.lit(-1).cast("bigint").alias("k"), "total")
    return e.unionByName(y).unionByName(o).select("level", "k", R("total").alias("median"))


@query("a11_quantiles", ops=("A11",), sql="""
SELECT round(CAST(q AS DOUBLE), 2) AS q, round(value, 4) AS value FROM (
  SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q,
         unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9])) AS value FROM lineitem)""")
def a_quantiles(spark, sf_dir):
    d = A.quantiles(P.table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.25, 0.5, 0.75, 0.9])
    return d.select(R("q", 2).alias("q"), R("value").alias("value"))


@query("a12_describe", ops=("A12",), sql="""
WITH s AS (SELECT * FROM lineitem)
SELECT c AS "column", statistic, round(value, 4) AS value FROM (
  SELECT 'l_quantity' AS c, [count(l_quantity), avg(l_quantity), stddev_samp(l_quantity), min(l_quantity),
         quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), max(l_quantity)] AS vals FROM s
  UNION ALL SELECT 'l_extendedprice', [count(l_extendedprice), avg(l_extendedprice), stddev_samp(l_extendedprice), min(l_extendedprice),
         quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.75), max(l_extendedprice)] FROM s
  UNION ALL SELECT 'l_discount', [count(l_discount), avg(l_discount), stddev_samp(l_discount), min(l_discount),
         quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.75), max(l_discount)] FROM s
  UNION ALL SELECT 'l_tax', [count(l_tax), avg(l_tax), stddev_samp(l_tax), min(l_tax),
         quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.75), max(l_tax)] FROM s
) t, (SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic,
             unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i) st
CROSS JOIN LATERAL (SELECT CAST(vals[i] AS DOUBLE) AS value)""")
def a_describe(spark, sf_dir):
    d = A.describe_numeric(P.table(spark, sf_dir, "lineitem"), LI_COLS)
    return d.select("column", "statistic", R("value").alias("value"))


SKEW_SQL = """
SELECT c AS "column", round(sk, 6) AS skewness, round(ku, 6) AS kurtosis FROM (
  SELECT 'l_quantity' AS c, {s}(l_quantity) AS sk, {k}(l_quantity) AS ku FROM lineitem
  UNION ALL SELECT 'l_extendedprice', {s}(l_extendedprice), {k}(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', {s}(l_discount), {k}(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', {s}(l_tax), {k}(l_tax) FROM lineitem)"""


@query("a13_skew_kurtosis_corrected", ops=("A13", "X-U5"), sql=SKEW_SQL.format(s="skewness", k="kurtosis"))
def a_skew_corrected(spark, sf_dir):
    d = A.skew_kurt(P.table(spark, sf_dir, "lineitem"), LI_COLS, bias=False)
    return d.select("column", R("skewness", 6).alias("skewness"), R("kurtosis", 6).alias("kurtosis"))


@query("a14_skew_kurtosis_biased", ops=("A14",), sql="""
SELECT c AS "column", round(sk * (n - 2) / sqrt(n * (n - 1)), 6) AS skewness, round(ku, 6) AS kurtosis FROM (
  SELECT 'l_quantity' AS c, skewness(l_quantity) AS sk, kurtosis_pop(l_quantity) AS ku, count(l_quantity) AS n FROM lineitem
  UNION ALL SELECT 'l_extendedprice', skewness(l_extendedprice), kurtosis_pop(l_extendedprice), count(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', skewness(l_discount), kurtosis_pop(l_discount), count(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', skewness(l_tax), kurtosis_pop(l_tax), count(l_tax) FROM lineitem)""")
def a_skew_biased(spark, sf_dir):
    d = A.skew_kurt(P.table(spark, sf_dir, "lineitem"), LI_COLS, bias=True)
    return d.select("column", R("skewness", 6).alias("skewness"), R("kurtosis", 6).alias("kurtosis"))


def _pairs_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM lineitem")
            if a != b:
                parts.append(f"SELECT '{b}', '{a}', corr({a}, {b}) FROM lineitem")
    return " UNION ALL ".join(parts)


@query("a15_correlation_matrix", ops=("A15",), sql=f"SELECT a, b, round(c, 6) AS corr FROM ({_pairs_sql(LI_COLS)})")
def a_corr_matrix(spark, sf_dir):
    d = A.corr_matrix(P.table(spark, sf_dir, "lineitem"), LI_COLS)
    return d.select("a", "b", R("corr", 6).alias("corr"))


@query("a16_o05_target_corr_head_tail", ops=("A16", "O5"), sql=Q.with_(Q.SPARSE) + """
, c AS (SELECT 'v' AS feature, corr(v, total) AS corr FROM pitem UNION ALL SELECT 'n', corr(n, total) FROM pitem
        UNION ALL SELECT 'mo', corr(mo, total) FROM pitem UNION ALL SELECT 'yr', corr(yr, total) FROM pitem
        UNION ALL SELECT 'item', corr(item, total) FROM pitem)
SELECT feature, round(corr, 6) AS corr, 'top' AS "end" FROM (SELECT * FROM c ORDER BY corr DESC NULLS LAST, feature LIMIT 2)
UNION ALL SELECT feature, round(corr, 6), 'bottom' FROM (SELECT * FROM c ORDER BY corr ASC NULLS LAST, feature LIMIT 2)""")
def a_target_corr(spark, sf_dir):
    d = A.target_corr(P.panel_with_item(spark, sf_dir), "total", ["v", "n", "mo", "yr", "item"])
    return O.head_tail(d, "corr", 2, ["feature"]).select("feature", R("corr", 6).alias("corr"), "end")


@query("a17_histogram", ops=("A17",), sql="""
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem),
b AS (SELECT least(greatest(CAST(floor((l_extendedprice - lo) / w) AS BIGINT) + 1, 1), 10) AS bin FROM lineitem, mm),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT CAST(i AS BIGINT) AS bin, round(lo + (i - 1) * w, 4) AS lo, round(lo + i * w, 4) AS hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM range(1, 11) r(i) CROSS JOIN mm LEFT JOIN c ON c.bin = r.i""")
def a_histogram(spark, sf_dir):
    d = A.histogram(P.table(spark, sf_dir, "lineitem"), "l_extendedprice", 10)
    return d.select("bin", R("lo").alias("lo"), R("hi").alias("hi"), "count")


@query("a18_pivot_mean_year_by_month", ops=("A18",), sql=Q.with_(Q.PANEL) + ", " + """
x AS (SELECT yr, """ + ", ".join(f'round(avg(v) FILTER (WHERE mo = {m}), 4) AS "{m}"' for m in range(1, 13)) + """ FROM panel GROUP BY yr)
SELECT * FROM x""")
def a_pivot_mean(spark, sf_dir):
    d = A.pivot_mean(P.base_panel(spark, sf_dir), "yr", "mo", "v", list(range(1, 13)))
    return d.select("yr", *[R(F.col(f"`{m}`")).alias(str(m)) for m in range(1, 13)])


@query("a19_pivot_first_entity_by_year", ops=("A19",), sql=Q.with_(Q.SPARSE) + """
SELECT entity, """ + ", ".join(f'round(first(item ORDER BY item) FILTER (WHERE yr = {y} AND item IS NOT NULL), 4) AS "{y}"'
                                for y in range(1995, 2002)) + """ FROM sparse GROUP BY entity""")
def a_pivot_first(spark, sf_dir):
    d = A.pivot_first(P.sparse_item(spark, sf_dir), ["entity"], "yr", "item", list(range(1995, 2002)))
    return d.select("entity", *[R(F.col(f"`{y}`")).alias(str(y)) for y in range(1995, 2002)])


@query("a20_melt_wide_to_long", ops=("A20", "F26"), sql=Q.with_(Q.SPARSE) + """
SELECT entity, yr, mo, variable, round(value, 4) AS value FROM (
  SELECT entity, yr, mo, 'v' AS variable, v AS value FROM pitem UNION ALL
  SELECT entity, yr, mo, 'n', CAST(n AS DOUBLE) FROM pitem UNION ALL
  SELECT entity, yr, mo, 'item', item FROM pitem) WHERE value IS NOT NULL""")
def a_melt(spark, sf_dir):
    d = A.melt(P.panel_with_item(spark, sf_dir), ["entity", "yr", "mo"], ["v", "n", "item"], cast="double", dropna=True)
    return d.withColumn("value", R("value"))


@query("a21_distinct_pairs", ops=("A21",), sql="""
SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer""")
def a_distinct_pairs(spark, sf_dir):
    return A.distinct_pairs(P.table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("a22_arg_max_min", ops=("A22",), sql=Q.with_(Q.YEARLY) + """
SELECT entity, arg_max(yr, (total, -yr)) AS argmax, arg_min(yr, (total, yr)) AS argmin,
       round(max(total), 4) AS max, round(min(total), 4) AS min FROM yearly GROUP BY entity""")
def a_arg_extreme(spark, sf_dir):
    d = A.arg_extreme(P.yearly_panel(spark, sf_dir), "yr", "total", ["entity"])
    return d.select("entity", "argmax", "argmin", R("max").alias("max"), R("min").alias("min"))


@query("a23_mode", ops=("A23",), sql="""
SELECT l_returnflag, arg_max(l_quantity, (cnt, -l_quantity)) AS mode FROM (
  SELECT l_returnflag, l_quantity, count(*) AS cnt FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def a_mode(spark, sf_dir):
    return A.mode(P.table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query("a24_entity_totals", ops=("A24",), sql=Q.with_(Q.PANEL) + """
SELECT entity, round(sum(yt), 2) AS total, CAST(count(*) AS BIGINT) AS n_years
FROM (SELECT entity, yr, sum(total) AS yt FROM panel GROUP BY 1, 2) GROUP BY entity""")
def a_entity_totals(spark, sf_dir):
    d = A.entity_totals(P.base_panel(spark, sf_dir), P.PANEL, "total")
    return d.select("entity", R("total", 2).alias("total"), "n_years")


MODELS_SQL = """mp AS (
  SELECT entity, yr, mo, total AS y, avg(total) OVER (PARTITION BY entity) AS m_entity,
         avg(total) OVER (PARTITION BY yr) AS m_year, total * 1.05 AS m_scaled FROM panel)"""
MODELS = ["m_entity", "m_year", "m_scaled"]


def model_preds(spark, sf_dir):
    """Prediction table analogue: actual ``y`` and three fixed-rule models
    (entity mean, year mean, 1.05 x actual). Group means are aggregates
    joined back (partial aggregation), not unbounded windows."""
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", F.col("total").alias("y"))
    p = J.with_group_stat(p, ["entity"], F.avg("y"), "m_entity")
    p = J.with_group_stat(p, ["yr"], F.avg("y"), "m_year")
    return p.withColumn("m_scaled", F.col("y") * 1.05)


@query("a25_annualize_all_models", ops=("A25",), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
SELECT entity, yr, round(sum(y), 2) AS y, round(sum(m_entity), 6) AS m_entity, round(sum(m_year), 6) AS m_year,
       round(sum(m_scaled), 4) AS m_scaled FROM mp GROUP BY 1, 2""")
def a_annualize(spark, sf_dir):
    d = A.annualize(model_preds(spark, sf_dir), ["entity", "yr"], ["y", *MODELS], mode="sum")
    return d.select("entity", "yr", R("y", 2).alias("y"), R("m_entity", 6).alias("m_entity"),
                    R("m_year", 6).alias("m_year"), R("m_scaled", 4).alias("m_scaled"))


@query("a26_v17_total_error_per_model", ops=("A26", "V17"), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
, t AS (SELECT sum(y) AS a, sum(m_entity) AS e, sum(m_year) AS yy, sum(m_scaled) AS s FROM mp)
SELECT 'm_entity' AS model, round(a, 2) AS actual_total, round(e, 4) AS pred_total, round(100 * (e - a) / a, 6) + 0.0 AS pct_error FROM t
UNION ALL SELECT 'm_year', round(a, 2), round(yy, 4), round(100 * (yy - a) / a, 6) + 0.0 FROM t
UNION ALL SELECT 'm_scaled', round(a, 2), round(s, 4), round(100 * (s - a) / a, 6) + 0.0 FROM t""")
def a_total_error(spark, sf_dir):
    d = A.total_error(model_preds(spark, sf_dir), "y", MODELS)
    return d.select("model", R("actual_total", 2).alias("actual_total"), R("pred_total", 4).alias("pred_total"),
                    R("pct_error", 6).alias("pct_error"))


@query("a27_top_variance_columns", ops=("A27",), sql="""
SELECT "column", round(variance, 6) AS variance FROM (
  SELECT 'l_quantity' AS "column", var_samp(l_quantity) AS variance FROM lineitem
  UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem) ORDER BY variance DESC, "column" LIMIT 2""")
def a_top_variance(spark, sf_dir):
    d = A.top_variance(P.table(spark, sf_dir, "lineitem"), LI_COLS, 2)
    return d.select("column", R("variance", 6).alias("variance"))


@query("a28_conditional_count_share", ops=("A28",), sql="""
SELECT l_returnflag, CAST(count_if(l_discount > 0.05) AS BIGINT) AS n_true, CAST(count(*) AS BIGINT) AS n,
       round(count_if(l_discount > 0.05) / count(*), 6) AS share FROM lineitem GROUP BY 1""")
def a_count_if(spark, sf_dir):
    d = A.count_if(P.table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05, ["l_returnflag"])
    return d.withColumn("share", R("share", 6))


@query("a29_sorted_distinct_values", ops=("A29",), sql="""
SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders ORDER BY 1""")
def a_sorted_values(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"))
    return A.sorted_values(o, "yr")


@query("a30_rank_means", ops=("A30", "O2"), sql=Q.with_(Q.PANEL) + """
SELECT entity, round(avg(total), 4) AS mean FROM panel GROUP BY 1 ORDER BY mean DESC, entity""")
def a_rank_means(spark, sf_dir):
    return A.rank_means(P.base_panel(spark, sf_dir), "entity", "total").withColumn("mean", R("mean"))


@query("a31_v15_cv_summary_by_year_folds", ops=("A31", "V15", "V1"), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
, f AS (SELECT yr AS fold, sqrt(avg((y - m_entity) * (y - m_entity))) AS rmse, avg(abs(y - m_entity)) AS mae FROM mp GROUP BY yr)
SELECT round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std,
       round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std FROM f""")
def a_cv_summary(spark, sf_dir):
    from panelforge.operators import evaluate as V
    folds = V.metrics(model_preds(spark, sf_dir), "y", "m_entity", by=["yr"])
    d = A.cv_summary(folds, ["rmse", "mae"])
    return d.select(*[R(c).alias(c) for c in ("rmse_mean", "rmse_std", "mae_mean", "mae_std")])


@query("a32_ordered_collect", ops=("A32", "M17", "X-U2"), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, CAST(row_number() OVER (PARTITION BY entity, yr ORDER BY mo) - 1 AS BIGINT) AS step, mo, round(v, 4) AS v
FROM panel WHERE mo BETWEEN 2 AND 8""")
def a_collect_ordered(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).where(F.col("mo").between(2, 8))
    seq = A.collect_ordered(p, ["entity", "yr"], "mo", ["mo", "v"])
    return seq.select("entity", "yr", F.posexplode("sequence").alias("step", "s")).select(
        "entity", "yr", "step", F.col("s.mo").alias("mo"), R(F.col("s.v")).alias("v"))


@query("a33_box_stats", ops=("A33",), sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS med,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT l_returnflag, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
       round(min(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN lo AND hi), 4) AS whisker_lo,
       round(max(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN lo AND hi), 4) AS whisker_hi,
       CAST(count_if(NOT (l_extendedprice BETWEEN lo AND hi)) AS BIGINT) AS n_outliers
FROM lineitem JOIN f USING (l_returnflag) GROUP BY l_returnflag, q1, med, q3""")
def a_box(spark, sf_dir):
    d = A.box_stats(P.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return d.select("l_returnflag", R("q1").alias("q1"), R("median").alias("median"), R("q3").alias("q3"),
                    R("whisker_lo").alias("whisker_lo"), R("whisker_hi").alias("whisker_hi"), "n_outliers")


@query("a34_gram_cross_products", ops=("A34",), sql="""
SELECT a, b, round(s, 4) AS sum_ab FROM (
  SELECT 'l_quantity' AS a, 'l_quantity' AS b, sum(l_quantity * l_quantity) AS s FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', sum(l_quantity * l_discount) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_tax', sum(l_quantity * l_tax) FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_discount', sum(l_discount * l_discount) FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_tax', sum(l_discount * l_tax) FROM lineitem
  UNION ALL SELECT 'l_tax', 'l_tax', sum(l_tax * l_tax) FROM lineitem)""")
def a_gram(spark, sf_dir):
    d = A.gram_long(P.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return d.withColumn("sum_ab", R("sum_ab"))


@query("a35_kernel_density", ops=("A35",), sql="""
WITH st AS (SELECT count(l_discount) AS n, stddev_samp(l_discount) AS sd, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem),
g AS (SELECT CAST(i AS BIGINT) AS i, lo + i * (hi - lo) / 19 AS x, sd * pow(n, -1.0 / 5.0) AS h, n FROM range(0, 20) r(i), st)
SELECT i, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - l_discount) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g, lineitem GROUP BY i, x, h, n""")
def a_kde(spark, sf_dir):
    d = A.kde(P.table(spark, sf_dir, "lineitem"), "l_discount", 20)
    return d.select("i", R("x", 6).alias("x"), R("density", 6).alias("density"))


# ---------------------------------------------------------------- O: ordering
@query("o01_o03_top_k_customers", ops=("O1", "O3", "A1"), sql="""
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1
ORDER BY spend DESC, o_custkey LIMIT 10""")
def o_top_k(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(R(F.sum("o_totalprice"), 2).alias("spend"))
    return O.top_k(o, "spend", 10, ["o_custkey"])


@query("o04_n_largest", ops=("O4",), sql="""
SELECT CAST(l_partkey AS BIGINT) AS l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1
ORDER BY qty DESC, l_partkey LIMIT 5""")
def o_n_largest(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(R(F.sum("l_quantity"), 2).alias("qty"))
    return O.top_k(li, "qty", 5, ["l_partkey"])


@query("o06_row_cap_by_key", ops=("O6",), sql="""
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100""")
def o_limit(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", R("o_totalprice", 2).alias("o_totalprice"))
    return O.limit_samples(o, ["o_orderkey"], 100)


@query("o07_seeded_sample", ops=("O7",), sql="""
SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500""")
def o_sample(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return O.sample_n(o, ["o_orderkey"], 500, seed=42)


@query("w14_rank_all_orders", ops=("W14",), sql="""
SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank
FROM orders""")
def w_rank_orders(spark, sf_dir):
    """Every order's place by price: the distributed global row index over whole rows."""
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return W.rank_entities(o, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice", "rank")


@query("o08_middle_row", ops=("O8",), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, mo, n FROM (SELECT *, row_number() OVER (ORDER BY entity, yr, mo) AS rn, count(*) OVER () AS cnt FROM panel)
WHERE rn = cnt // 2 + 1""")
def o_middle(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", "n")
    n = p.count()
    return O.pick_row(p, ["entity", "yr", "mo"], n // 2)


@query("a10_grouped_median_skew_balanced", ops=("A10", "A11"), sql="""
SELECT l_returnflag, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
FROM lineitem GROUP BY l_returnflag""")
def a_grouped_median_sorted(spark, sf_dir):
    """Exact grouped quantiles through the range-partitioned method: the
    largest return-flag group is split across ranges instead of one task."""
    li = P.table(spark, sf_dir, "lineitem")
    d = A.grouped_quantiles(li, ["l_returnflag"], "l_extendedprice", [0.5, 0.9], ["median", "p90"])
    return d.select("l_returnflag", R("median").alias("median"), R("p90").alias("p90"))
