"""Feature engineering (E*) and ML-preparation statistics (M1-M12, M17,
M18, M20, M36) over the driver panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import features as E
from panelforge.operators import joins as J
from panelforge.operators import mlprep as M
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query

SPEC = P.PANEL


def TRAIN():
    return F.col("yr") < 2000


def R(c, n=4):
    return F.round(c, n)


def feature_panel(spark, sf_dir):
    """Monthly panel + sparse item + national monthly price + static dim."""
    d = J.left_enrich(P.panel_with_item(spark, sf_dir), P.monthly_price(spark, sf_dir), ["yr", "mo"])
    return J.left_enrich(d, P.static_dim(spark, sf_dir), ["entity"])


FP_SQL = Q.SPARSE + ",\n" + Q.PRICE + ",\n" + Q.DIM + """,
fp AS (SELECT * FROM pitem LEFT JOIN price USING (yr, mo) LEFT JOIN dim USING (entity))"""

# role of each reference input played by a driver-panel column
ROLES = {
    "SoilMoi0_10cm_inst": "v", "SoilMoi100_200cm_inst": "price", "prism_tmax_degf": "total",
    "prism_tmin_degf": "v", "prism_ppt_in": "n", "Evap_tavg": "dist", "corn_production_bu": "total",
    "corn_acres_planted": "n", "diesel_usd_gal": "price", "income_farmrelated_receipts_total_usd": "item",
    "govt_programs_federal_receipts_usd": "v", "SoilTMP0_10cm_inst": "price", "SoilTMP100_200cm_inst": "v",
    "Wind_f_inst": "mo",
}
FEATURES = [f[0] for f in E.FEATURE_DEFS]


@query("e04_e19_engineered_features", ops=("E4", "E5", "E7", "E8", "E9", "E10", "E11", "E12", "E13", "E16",
                                            "E17", "E18", "E19", "F21", "F22"),
       sql=Q.with_(FP_SQL) + """
SELECT entity, yr, mo,
  round(price - v, 4) AS soil_moisture_gradient, round(total - v, 4) AS temperature_range,
  round(n - dist, 4) AS precipitation_evap_balance, round(v / (n + 1e-8), 4) AS precipitation_efficiency,
  round(total / (n + 1e-8), 4) AS yield_per_acre, round(price * n, 4) AS fuel_cost_proxy,
  round(item + v, 4) AS total_revenue_sources, round(item / (total + 1e-8), 6) AS revenue_per_bushel,
  round(dist * v, 4) AS evap_moist_interact, round(v / (dist + 1e-8), 4) AS soil_evap_ratio,
  round(price - v, 4) AS temp_gradient, round(mo * v, 4) AS wind_moist_interact,
  round((v + price) / 2, 4) AS soil_moisture_avg
FROM fp""")
def e_features(spark, sf_dir):
    d = feature_panel(spark, sf_dir)
    d, used = E.add_features(d, E.registry(ROLES))
    d = E.pattern_mean(d, ["v", "price"], "soil_moisture_avg", candidates=["v", "price"])
    six = {"revenue_per_bushel"}
    return d.select("entity", "yr", "mo", *[R(f, 6 if f in six else 4).alias(f) for f in FEATURES],
                    R("soil_moisture_avg").alias("soil_moisture_avg"))


@query("e01_e02_e03_time_features", ops=("E1", "E2", "E3", "F14"), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, mo, yr - (SELECT min(yr) FROM panel) AS year_trend, yr - 2000 AS year_trend_2000,
       round(sin(2 * pi() * mo / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * mo / 12), 6) + 0.0 AS month_cos FROM panel""")
def e_time(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo")
    d = E.year_trend(p, "yr")
    d = E.year_trend(d, "yr", base=2000, out="year_trend_2000")
    d = E.month_features(d, "mo")
    return d.withColumns({"month_sin": R("month_sin", 6), "month_cos": R("month_cos", 6)})


@query("e21_p25_target_quartiles", ops=("E21", "P25", "A8"), sql=Q.with_(Q.YEARLY) + """
, e AS (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.5) AS q2, quantile_cont(total, 0.75) AS q3 FROM yearly),
l AS (SELECT total, CASE WHEN total <= q1 THEN 0 WHEN total <= q2 THEN 1 WHEN total <= q3 THEN 2 ELSE 3 END AS quartile FROM yearly, e)
SELECT CAST(quartile AS BIGINT) AS quartile, CAST(count(*) AS BIGINT) AS n, round(avg(total), 4) AS mean_total FROM l GROUP BY 1""")
def e_quartiles(spark, sf_dir):
    y = E.target_quartile(P.yearly_panel(spark, sf_dir), "total", out="quartile")
    return y.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), R(F.avg("total")).alias("mean_total"))


TE_SQL = """te_in AS (SELECT entity, yr, mo, entity * 100 + mo AS cell, total FROM panel),
st AS (SELECT cell, count(total) AS n, avg(total) AS m FROM te_in WHERE {fit} GROUP BY cell),
pr AS (SELECT avg(total) AS prior FROM te_in WHERE {fit})"""
TE_SELECT = """
SELECT entity, yr, mo, round(coalesce(CASE WHEN n = 1 THEN prior
          ELSE prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + m * (1 / (1 + exp(-(n - 20) / 10.0))) END, prior), 4) AS cell_encoded
FROM te_in LEFT JOIN st USING (cell), pr"""


def _te_input(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    return p.select("entity", "yr", "mo", (F.col("entity") * 100 + F.col("mo")).alias("cell"), "total")


@query("e22_target_encoding_train_fit", ops=("E22", "M9"), sql=Q.with_(Q.PANEL, TE_SQL.format(fit="yr < 2000")) + TE_SELECT)
def e_target_encode(spark, sf_dir):
    d = E.target_encode(_te_input(spark, sf_dir), "cell", "total", fit_on=TRAIN())
    return d.select("entity", "yr", "mo", R("cell_encoded").alias("cell_encoded"))


@query("e23_target_encoding_all_rows", ops=("E23",), sql=Q.with_(Q.PANEL, TE_SQL.format(fit="TRUE")) + TE_SELECT)
def e_target_encode_all(spark, sf_dir):
    d = E.target_encode(_te_input(spark, sf_dir), "cell", "total", fit_on=None)
    return d.select("entity", "yr", "mo", R("cell_encoded").alias("cell_encoded"))


@query("e24_inverse_weight", ops=("E24",), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, mo, round((1 / (n + 1)) / (SELECT avg(1 / (n + 1)) FROM panel), 6) AS sample_weight FROM panel""")
def e_weight(spark, sf_dir):
    d = E.inverse_weight(P.base_panel(spark, sf_dir), "n")
    return d.select("entity", "yr", "mo", R("sample_weight", 6).alias("sample_weight"))


@query("e25_u03_selected_plus_must_have", ops=("E25", "U3", "A27"), sql="""
SELECT DISTINCT band FROM (
  (SELECT band FROM (SELECT 'l_quantity' AS band, var_samp(l_quantity) AS v FROM lineitem
                     UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem
                     UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem) ORDER BY v DESC, band LIMIT 1)
  UNION ALL SELECT 'l_tax' UNION ALL SELECT 'l_discount')""")
def e_bands(spark, sf_dir):
    top = A.top_variance(P.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 1)
    return J.select_bands(top.withColumnRenamed("column", "band"), ["l_tax", "l_discount"])


# ---------------------------------------------------------------- M: scaling, imputation, splits
@query("m01_robust_scale_train_fit", ops=("M1",), sql=Q.with_(Q.PANEL) + """
, s AS (SELECT median(total) AS med, quantile_cont(total, 0.75) - quantile_cont(total, 0.25) AS iqr,
               median(v) AS medv, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqrv FROM panel WHERE yr < 2000)
SELECT entity, yr, mo, round((total - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) + 0.0 AS total,
       round((v - medv) / CASE WHEN iqrv = 0 THEN 1 ELSE iqrv END, 6) + 0.0 AS v FROM panel, s""")
def m_robust(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", "total", "v")
    d = M.robust_scale(p, ["total", "v"], fit_on=TRAIN())
    return d.select("entity", "yr", "mo", R("total", 6).alias("total"), R("v", 6).alias("v"))


@query("m03_standard_scale_all_rows", ops=("M3", "M2"), sql=Q.with_(Q.PANEL) + """
, s AS (SELECT avg(total) AS m, stddev_pop(total) AS sd FROM panel)
SELECT entity, yr, mo, round((total - m) / sd, 6) + 0.0 AS total FROM panel, s""")
def m_standard_all(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", "total")
    return M.standard_scale(p, ["total"]).withColumn("total", R("total", 6))


@query("m04_a32_scaled_sequences", ops=("M4", "A32"), sql=Q.with_(Q.PANEL) + """
, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM panel WHERE mo BETWEEN 2 AND 8)
SELECT entity, yr, CAST(row_number() OVER (PARTITION BY entity, yr ORDER BY mo) - 1 AS BIGINT) AS step,
       round((v - m) / sd, 6) AS v FROM panel, s WHERE mo BETWEEN 2 AND 8""")
def m_scale_sequences(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).where(F.col("mo").between(2, 8))
    scaled = M.standard_scale(p, ["v"])
    seq = A.collect_ordered(scaled, ["entity", "yr"], "mo", ["v"])
    return seq.select("entity", "yr", F.posexplode("sequence").alias("step", "s")).select(
        "entity", "yr", "step", R(F.col("s.v"), 6).alias("v"))


@query("m05_m36_minmax_and_inverse", ops=("M5", "M36"), sql=Q.with_(Q.PANEL) + """
, s AS (SELECT min(total) AS lo, max(total) - min(total) AS rng FROM panel)
SELECT entity, yr, mo, round((total - lo) / rng, 6) AS scaled, round(((total - lo) / rng) * rng + lo, 4) AS restored FROM panel, s""")
def m_minmax(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", "total")
    st = M.fit_minmax(p, ["total"])
    d = M.transform(p, st).withColumnRenamed("total", "scaled")
    d = d.withColumn("total", F.col("scaled"))
    d = M.inverse(d, st, ["total"])
    return d.select("entity", "yr", "mo", R("scaled", 6).alias("scaled"), R("total").alias("restored"))


@query("m06_m07_train_imputers", ops=("M6", "M7"), sql=Q.with_(Q.SPARSE) + """
, s AS (SELECT median(item) AS med, avg(item) AS mean FROM pitem WHERE yr < 2000)
SELECT entity, yr, mo, round(coalesce(item, med), 4) AS item_median, round(coalesce(item, mean), 4) AS item_mean FROM pitem, s""")
def m_imputers(spark, sf_dir):
    d = P.panel_with_item(spark, sf_dir).select("entity", "yr", "mo", "item")
    a = M.impute(d, ["item"], "median", fit_on=TRAIN()).withColumnRenamed("item", "item_median")
    b = M.impute(d, ["item"], "mean", fit_on=TRAIN()).withColumnRenamed("item", "item_mean")
    out = a.join(b, ["entity", "yr", "mo"])
    return out.select("entity", "yr", "mo", R("item_median").alias("item_median"), R("item_mean").alias("item_mean"))


@query("m08_entity_then_global_mean", ops=("M8", "X-U3"), sql=Q.with_(Q.SPARSE) + """
SELECT entity, yr, mo, round(coalesce(item, avg(item) OVER (PARTITION BY entity), (SELECT avg(item) FROM pitem)), 4) AS item FROM pitem""")
def m_group_mean(spark, sf_dir):
    d = P.panel_with_item(spark, sf_dir).select("entity", "yr", "mo", "item")
    return M.impute_group_mean(d, ["item"], "entity").withColumn("item", R("item"))


@query("m09_m12_split_balance", ops=("M9", "M12", "A9"), sql=Q.with_(Q.YEARLY) + """
, e AS (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.5) AS q2, quantile_cont(total, 0.75) AS q3 FROM yearly),
l AS (SELECT CASE WHEN yr < 2000 THEN 'train' ELSE 'test' END AS split,
             CASE WHEN total <= q1 THEN 0 WHEN total <= q2 THEN 1 WHEN total <= q3 THEN 2 ELSE 3 END AS quartile FROM yearly, e),
c AS (SELECT split, quartile, count(*) AS n FROM l GROUP BY 1, 2)
SELECT split, CAST(quartile AS BIGINT) AS quartile, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM c""")
def m_balance(spark, sf_dir):
    y = E.target_quartile(P.yearly_panel(spark, sf_dir), "total", out="quartile")
    y = y.withColumn("split", M.split_label("yr", 2000))
    return M.balance(y, "quartile", "split").withColumn("share", R("share", 6))


@query("m10_m11_hash_folds_and_holdout", ops=("M10", "M11"), sql=Q.with_(Q.PANEL) + """
, h AS (SELECT entity, yr, mo, md5('42|' || entity || '|' || yr || '|' || mo) AS h FROM panel)
SELECT entity, yr, mo, CAST((row_number() OVER (ORDER BY h, entity, yr, mo) - 1) % 5 AS BIGINT) AS fold,
       CASE WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split
FROM h""")
def m_folds(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    d = M.kfold(p, ["entity", "yr", "mo"], k=5, seed=42)
    d = M.random_split(d, ["entity", "yr", "mo"], 0.2, seed=42)
    return d.select("entity", "yr", "mo", "fold", "split")


SEQ_SQL = """g AS (SELECT entity, yr, count(*) AS n_steps FROM panel WHERE mo BETWEEN 2 AND 8 GROUP BY 1, 2),
s AS (SELECT entity, yr, row_number() OVER (PARTITION BY entity, yr ORDER BY mo) - 1 AS step, v FROM panel WHERE mo BETWEEN 2 AND 8)"""


@query("m17_strict_sequences", ops=("M17",), sql=Q.with_(Q.PANEL, SEQ_SQL) + """
SELECT entity, yr, CAST(step AS BIGINT) AS step, round(v, 4) AS v FROM s JOIN g USING (entity, yr) WHERE n_steps = 7""")
def m_strict(spark, sf_dir):
    seq = M.sequences(P.base_panel(spark, sf_dir), SPEC, ["v"], mode="strict")
    return seq.select("entity", "yr", F.posexplode("sequence").alias("step", "x")).select(
        "entity", "yr", "step", R(F.col("x")[0]).alias("v"))


@query("m18_padded_sequences", ops=("M18",), sql=Q.with_(Q.PANEL, SEQ_SQL) + """
SELECT g.entity, g.yr, CAST(t.step AS BIGINT) AS step, round(coalesce(s.v, 0.0), 4) AS v
FROM g CROSS JOIN range(0, 7) t(step) LEFT JOIN s ON s.entity = g.entity AND s.yr = g.yr AND s.step = t.step
WHERE g.n_steps <= 7""")
def m_padded(spark, sf_dir):
    seq = M.sequences(P.base_panel(spark, sf_dir), SPEC, ["v"], mode="pad")
    return seq.select("entity", "yr", F.posexplode("sequence").alias("step", "x")).select(
        "entity", "yr", "step", R(F.col("x")[0]).alias("v"))


@query("m20_interaction_terms", ops=("M20",), sql="""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
       round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax, round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem""")
def m_interactions(spark, sf_dir):
    from panelforge.operators.models import interactions
    li = P.table(spark, sf_dir, "lineitem")
    d, names = interactions(li, ["l_quantity", "l_discount", "l_tax"])
    inter = [n for n in names if "_x_" in n]
    return d.select("l_orderkey", "l_linenumber", *[R(n, 6).alias(n) for n in inter])
