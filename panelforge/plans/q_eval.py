"""Evaluation (V*) and hybrid-adjustment (H*) queries. The prediction table
is the panel's actual ``y`` with three fixed-rule models (entity mean, year
mean, 1.05 x actual); adjustments come from event payloads and supplier
balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.operators import aggregates as A
from panelforge.operators import evaluate as V
from panelforge.operators import features as E
from panelforge.operators import hybrid as H
from panelforge.operators import windows as W
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.q_agg import MODELS, MODELS_SQL, model_preds
from panelforge.plans.registry import query


def R(c, n=4):
    return F.round(c, n)


def _rounded(df, cols, n=4):
    return df.select(*[R(c, n).alias(c) if c in cols else c for c in df.columns])


METRIC_COLS = ["rmse", "mae", "r2", "mape"]


def _metric_sql(y, p, eps="1e-8"):
    return (f"CAST(count({y} - {p}) AS BIGINT) AS n, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 4) AS rmse, "
            f"round(avg(abs({y} - {p})), 4) AS mae, "
            f"round(1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop(CASE WHEN {p} IS NOT NULL THEN {y} END) * count({y} - {p})), 6) AS r2, "
            f"round(avg(abs(({y} - {p}) / ({y} + {eps}))) * 100, 6) AS mape")


def _metrics_out(df):
    return df.select(*[c for c in df.columns if c not in METRIC_COLS],
                     R("rmse").alias("rmse"), R("mae").alias("mae"), R("r2", 6).alias("r2"), R("mape", 6).alias("mape"))


@query("v01_v02_metrics", ops=("V1", "V2"), sql=Q.with_(Q.PANEL, MODELS_SQL) + f"SELECT {_metric_sql('y', 'm_entity')} FROM mp")
def v_metrics(spark, sf_dir):
    return _metrics_out(V.metrics(model_preds(spark, sf_dir), "y", "m_entity"))


@query("v03_mape_without_epsilon", ops=("V3",), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
SELECT round(avg(abs((y - m_year) / y)) * 100, 6) AS mape FROM mp""")
def v_mape_raw(spark, sf_dir):
    m = V.metrics(model_preds(spark, sf_dir), "y", "m_year", eps=None)
    return m.select(R("mape", 6).alias("mape"))


@query("v04_log_scale_metrics", ops=("V4", "F12", "F13"), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
SELECT 'log' AS scale, """ + _metric_sql("ln(y)", "ln(m_entity)") + """ FROM mp
UNION ALL SELECT 'log1p', """ + _metric_sql("ln(1 + y)", "ln(1 + m_entity)") + """ FROM mp""")
def v_log_metrics(spark, sf_dir):
    d = model_preds(spark, sf_dir)
    a = V.metrics(d, "y", "m_entity", scale="log").withColumn("scale", F.lit("log"))
    b = V.metrics(d, "y", "m_entity", scale="log1p").withColumn("scale", F.lit("log1p"))
    return _metrics_out(a.unionByName(b)).select("scale", "n", *METRIC_COLS)


LONG_SQL = """lp AS (SELECT entity, yr, mo, y, 'm_entity' AS model, m_entity AS pred FROM mp
  UNION ALL SELECT entity, yr, mo, y, 'm_year', m_year FROM mp UNION ALL SELECT entity, yr, mo, y, 'm_scaled', m_scaled FROM mp),
valid AS (SELECT * FROM lp WHERE y IS NOT NULL AND pred IS NOT NULL AND y > 0 AND pred > 0)"""


@query("v05_leaderboard_all_models", ops=("V5", "P12"), sql=Q.with_(Q.PANEL, MODELS_SQL, LONG_SQL) + f"""
SELECT model, {_metric_sql('y', 'pred')} FROM valid GROUP BY model""")
def v_leaderboard(spark, sf_dir):
    return _metrics_out(V.leaderboard(model_preds(spark, sf_dir), ["entity", "yr", "mo"], "y", MODELS))


@query("v06_ranked_leaderboard_with_class", ops=("V6", "O2"), sql=Q.with_(Q.PANEL, MODELS_SQL, LONG_SQL) + f"""
, b AS (SELECT model, {_metric_sql('y', 'pred')} FROM valid GROUP BY model),
cls AS (SELECT * FROM (VALUES ('m_entity', 'low'), ('m_year', 'low'), ('m_scaled', 'oracle')) t(model, complexity))
SELECT b.*, complexity FROM b LEFT JOIN cls USING (model) ORDER BY r2 DESC, model""")
def v_ranked(spark, sf_dir):
    board = _metrics_out(V.leaderboard(model_preds(spark, sf_dir), ["entity", "yr", "mo"], "y", MODELS))
    classes = spark.createDataFrame([("m_entity", "low"), ("m_year", "low"), ("m_scaled", "oracle")], "model string, complexity string")
    return V.ranked_leaderboard(board, classes)


@query("v07_residual_summary", ops=("V7",), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
SELECT round(avg(y - m_year), 4) + 0.0 AS mean_residual, round(stddev_samp(y - m_year), 4) AS std_residual,
       round(min(y - m_year), 4) AS min_residual, round(max(y - m_year), 4) AS max_residual FROM mp""")
def v_residuals(spark, sf_dir):
    d = V.residual_summary(model_preds(spark, sf_dir), "y", "m_year")
    return _rounded(d, d.columns)


@query("v08_error_percentiles", ops=("V8",), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
SELECT round(quantile_cont(pe, 0.25), 6) AS p25, round(quantile_cont(pe, 0.5), 6) AS p50,
       round(quantile_cont(pe, 0.75), 6) AS p75, round(quantile_cont(pe, 0.95), 6) AS p95
FROM (SELECT abs(y - m_entity) / (y + 1e-6) * 100 AS pe FROM mp)""")
def v_error_pct(spark, sf_dir):
    d = V.error_percentiles(model_preds(spark, sf_dir), "y", "m_entity")
    return _rounded(d, d.columns, 6)


QUART_SQL = """qe AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3 FROM mp),
mq AS (SELECT mp.*, CASE WHEN y <= q1 THEN 0 WHEN y <= q2 THEN 1 WHEN y <= q3 THEN 2 ELSE 3 END AS quartile FROM mp, qe)"""


@query("v09_metrics_by_quartile", ops=("V9", "E21"), sql=Q.with_(Q.PANEL, MODELS_SQL, QUART_SQL) + f"""
SELECT CAST(quartile AS BIGINT) AS quartile, {_metric_sql('y', 'm_entity', '1e-6')} FROM mq GROUP BY quartile""")
def v_by_quartile(spark, sf_dir):
    d = E.target_quartile(model_preds(spark, sf_dir), "y", out="quartile")
    return _metrics_out(V.metrics(d, "y", "m_entity", by=["quartile"], eps=1e-6))


@query("v10_v11_assessment_grades", ops=("V10", "V11", "F23"), sql=Q.with_(Q.PANEL, MODELS_SQL, LONG_SQL) + """
, m AS (SELECT model, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - pred) * (y - pred))) AS rmse,
               avg(abs((y - pred) / (y + 1e-6))) * 100 AS mape, avg(y) AS mean_y FROM lp GROUP BY model),
g AS (SELECT model, r2, rmse / mean_y AS ratio, mape FROM m)
SELECT model, round(ratio, 6) AS rmse_ratio,
  CASE WHEN r2 >= 0.9 THEN 'EXCELLENT' WHEN r2 >= 0.8 THEN 'GOOD' WHEN r2 >= 0.7 THEN 'FAIR' ELSE 'POOR' END AS r2_grade,
  CASE WHEN ratio <= 0.1 THEN 'EXCELLENT' WHEN ratio <= 0.2 THEN 'GOOD' ELSE 'MODERATE' END AS rmse_grade,
  CASE WHEN mape < 20 THEN 'EXCELLENT' WHEN mape < 30 THEN 'GOOD' WHEN mape < 50 THEN 'MODERATE' ELSE 'HIGH' END AS mape_grade,
  CASE WHEN r2 >= 0.9 AND ratio <= 0.2 THEN 'EXCELLENT' WHEN r2 >= 0.8 AND ratio <= 0.2 * 1.5 THEN 'GOOD'
       WHEN r2 >= 0.7 THEN 'FAIR' ELSE 'NEEDS IMPROVEMENT' END AS overall FROM g""")
def v_assess(spark, sf_dir):
    long = V.long_predictions(model_preds(spark, sf_dir), ["entity", "yr", "mo"], "y", MODELS)
    m = V.metrics_with_mean(long, "y", "pred", by=["model"])
    a = V.assess(m)
    return a.select("model", R("rmse_ratio", 6).alias("rmse_ratio"), "r2_grade", "rmse_grade", "mape_grade", "overall")


@query("v12_stage_improvements", ops=("V12",), sql=Q.with_(Q.PANEL, MODELS_SQL, LONG_SQL) + """
, m AS (SELECT model, CASE model WHEN 'm_year' THEN 1 WHEN 'm_entity' THEN 2 ELSE 3 END AS stage,
               1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - pred) * (y - pred))) AS rmse FROM lp GROUP BY model)
SELECT model, CAST(stage AS BIGINT) AS stage, round(r2 - lag(r2) OVER (ORDER BY stage), 6) AS r2_change,
       round(rmse - lag(rmse) OVER (ORDER BY stage), 4) AS rmse_change FROM m""")
def v_improvements(spark, sf_dir):
    long = V.long_predictions(model_preds(spark, sf_dir), ["entity", "yr", "mo"], "y", MODELS)
    m = V.metrics(long, "y", "pred", by=["model"])
    stage = F.when(F.col("model") == "m_year", 1).when(F.col("model") == "m_entity", 2).otherwise(3)
    d = V.improvements(m.withColumn("stage", stage), "stage", ["r2", "rmse"])
    return d.select("model", "stage", R("r2_change", 6).alias("r2_change"), R("rmse_change").alias("rmse_change"))


@query("v13_row_result_table", ops=("V13",), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
SELECT entity, yr, mo, round(ln(1 + y), 6) AS actual_log, round(ln(1 + m_entity), 6) AS predicted_log,
       round(exp(ln(1 + y)) - 1, 4) AS actual_original, round(exp(ln(1 + m_entity)) - 1, 6) AS predicted_original,
       round(ln(1 + m_entity) - ln(1 + y), 6) AS residual_log, round(abs(m_entity - y), 6) AS abs_error_original FROM mp""")
def v_result_table(spark, sf_dir):
    d = model_preds(spark, sf_dir).select("entity", "yr", "mo", F.log1p("y").alias("yl"), F.log1p("m_entity").alias("pl"))
    t = V.result_table(d, ["entity", "yr", "mo"], "yl", "pl")
    return t.select("entity", "yr", "mo", *[R(c, 4 if c == "actual_original" else 6).alias(c) for c in t.columns[3:]])


@query("v14_entity_errors_two_models", ops=("V14", "A25", "F15"), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
, a AS (SELECT entity, sum(y) AS y, sum(m_scaled) AS m_scaled, sum(m_year) AS m_year FROM mp GROUP BY entity)
SELECT entity, round(y, 2) AS y, round(m_scaled, 6) AS m_scaled, round(m_year, 6) AS m_year,
       round(m_scaled - y, 6) AS m_scaled_error, round(m_year - y, 6) AS m_year_error,
       round(100 * (m_scaled - y) / y, 6) AS m_scaled_pct_error, round(100 * (m_year - y) / y, 6) AS m_year_pct_error FROM a""")
def v_entity_errors(spark, sf_dir):
    a = A.annualize(model_preds(spark, sf_dir), ["entity"], ["y", "m_scaled", "m_year"], "sum")
    d = V.entity_errors(a, "entity", "y", "m_scaled", "m_year")
    return d.select("entity", *[R(c, 2 if c == "y" else 6).alias(c) for c in d.columns[1:]])


@query("v16_prediction_health", ops=("V16",), sql=Q.with_(Q.PANEL) + """
, preds AS (SELECT CASE WHEN n = 1 THEN 'inf'::DOUBLE WHEN n = 2 THEN NULL ELSE total * 1.05 END AS p FROM panel)
SELECT 'p' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(count_if(p IS NULL) AS BIGINT) AS n_null,
       CAST(count_if(isnan(p)) AS BIGINT) AS n_nan, CAST(count_if(isinf(p)) AS BIGINT) AS n_inf FROM preds""")
def v_health(spark, sf_dir):
    from panelforge.plans.q_core import _preds
    return V.prediction_health(_preds(spark, sf_dir), ["p"])


BIAS_SQL = """bl AS (SELECT y, 'm_entity' AS model, m_entity AS pred FROM mp UNION ALL SELECT y, 'm_year', m_year FROM mp
  UNION ALL SELECT y, 'm_high', y * 1.08 FROM mp UNION ALL SELECT y, 'm_near', y * 1.03 FROM mp)"""


@query("v19_bias_flags", ops=("V19",), sql=Q.with_(Q.PANEL, MODELS_SQL, BIAS_SQL) + """
, m AS (SELECT model, avg(y - pred) AS mr, stddev_samp(y - pred) AS sr, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(y) AS my FROM bl GROUP BY model)
SELECT model, round(mr / my, 6) + 0.0 AS relative_bias, CAST(abs(mr) > my * 0.05 AS BIGINT) AS biased,
       CAST(sr > rmse * 0.8 AS BIGINT) AS high_variance FROM m""")
def v_bias(spark, sf_dir):
    d = model_preds(spark, sf_dir).withColumns({"m_high": F.col("y") * 1.08, "m_near": F.col("y") * 1.03})
    long = V.long_predictions(d, ["entity", "yr", "mo"], "y", ["m_entity", "m_year", "m_high", "m_near"])
    b = V.bias_flags(long, "y", "pred", by=["model"])
    return b.select("model", (R(F.col("mean_residual") / F.col("mean_y"), 6) + 0.0).alias("relative_bias"),
                    "biased", "high_variance")


# ---------------------------------------------------------------- H: hybrid adjustment
EV_SQL = """ev AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 - 0.5 AS a FROM events)"""


def _events(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    k = S.parse_json_fields("props", "k double")["k"]
    return e.select("event_id", "value", (k / 100 - 0.5).alias("a"))


@query("h01_h02_adjust_only_with_bands", ops=("H1", "H2", "H4", "P19"), sql=Q.with_(EV_SQL) + """
SELECT event_id, round(value * (1 + greatest(-0.2, least(0.2, a))), 6) AS y_hyb,
       round(value * 0.8 * (1 + 0.7 * greatest(-0.2, least(0.2, a))), 6) AS p10_hyb,
       round(value * 1.2 * (1 + 0.7 * greatest(-0.2, least(0.2, a))), 6) AS p90_hyb FROM ev""")
def h_adjust(spark, sf_dir):
    d = H.default_uncertainty(_events(spark, sf_dir), "value")
    return d.select("event_id", R(H.adjust("value", "a"), 6).alias("y_hyb"), R(H.adjust_bands("p10", "a"), 6).alias("p10_hyb"),
                    R(H.adjust_bands("p90", "a"), 6).alias("p90_hyb"))


@query("h03_damped_adjustment", ops=("H3", "H4", "F17"), sql=Q.with_(EV_SQL) + """
, d AS (SELECT event_id, value, value * 0.2 AS band,
               greatest(-0.15, least(0.15, a)) * (1 - exp(-(value * 0.2) / (value * 0.1))) AS adj FROM (SELECT event_id, nullif(value, 0) AS value, a FROM ev))
SELECT event_id, round(adj, 6) AS adj, round(value * (1 + adj), 6) AS pred_adjusted,
       round((value - 0.5 * band) * (1 + 0.7 * adj), 6) AS low_80, round((value + 0.5 * band) * (1 + 0.7 * adj), 6) AS high_80 FROM d""")
def h_damped(spark, sf_dir):
    d = H.default_uncertainty(_events(spark, sf_dir).withColumn("value", F.nullif(F.col("value"), F.lit(0.0))), "value")
    d = H.damped_adjust(d, "value", "a", "band", "train_rmse")
    return d.select("event_id", *[R(c, 6).alias(c) for c in ("adj", "pred_adjusted", "low_80", "high_80")])


@query("h05_h06_prediction_intervals", ops=("H5", "H6", "M9"), sql=Q.with_(Q.PANEL, MODELS_SQL) + """
, q AS (SELECT quantile_cont(y - m_entity, 0.1) AS lo, quantile_cont(y - m_entity, 0.9) AS hi FROM mp WHERE yr < 2000)
SELECT entity, yr, mo, round(m_entity + lo, 4) AS p10, round(m_entity + hi, 4) AS p90,
       round(m_entity * 0.8, 4) AS p10_const, round(m_entity * 1.2, 4) AS p90_const FROM mp, q""")
def h_intervals(spark, sf_dir):
    d = model_preds(spark, sf_dir)
    q = H.intervals(d, "y", "m_entity", "quantile", fit_on=F.col("yr") < 2000)
    c = H.intervals(d, "y", "m_entity", "constant").select("entity", "yr", "mo", F.col("p10").alias("p10_const"),
                                                             F.col("p90").alias("p90_const"))
    out = q.select("entity", "yr", "mo", "p10", "p90").join(c, ["entity", "yr", "mo"])
    return _rounded(out, ["p10", "p90", "p10_const", "p90_const"])


STACK_W = {"m_entity": 0.5, "m_year": 0.3, "m_scaled": 0.2}


@query("h08_h09_stacked_with_fallback", ops=("H8", "H9"), sql=Q.with_(Q.PANEL, MODELS_SQL, Q.DIM) + """
, a AS (SELECT entity, dist / 100 - 0.45 AS adj FROM dim),
x AS (SELECT mp.*, CASE WHEN mo = 1 THEN NULL ELSE m_year END AS m_year_partial, adj FROM mp LEFT JOIN a USING (entity))
SELECT entity, yr, mo,
  round(0.5 * m_entity + 0.3 * m_year + 0.2 * m_scaled, 4) AS y_stack,
  round(CASE WHEN m_entity IS NOT NULL AND m_year_partial IS NOT NULL AND m_scaled IS NOT NULL
             THEN 0.5 * m_entity + 0.3 * m_year_partial + 0.2 * m_scaled
             ELSE m_entity * (1 + greatest(-0.2, least(0.2, coalesce(adj, 0.0)))) END, 4) AS y_hybrid FROM x""")
def h_stacked(spark, sf_dir):
    d = model_preds(spark, sf_dir)
    adj = P.static_dim(spark, sf_dir).select("entity", (F.col("dist") / 100 - 0.45).alias("adj"))
    d = d.join(adj, "entity", "left")
    d = H.stack(d, STACK_W)
    d = d.withColumn("m_year", F.when(F.col("mo") == 1, F.lit(None)).otherwise(F.col("m_year")))
    d = H.hybrid(d, "m_entity", "adj", "stacked", stack_cols=MODELS, weights=STACK_W)
    return d.select("entity", "yr", "mo", R("y_stack").alias("y_stack"), R("y_hybrid").alias("y_hybrid"))


RESP_SQL = """resp AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'not json'
    ELSE (CASE WHEN event_type = 'click' THEN '```json' || chr(10) ELSE '' END)
      || '{"adjustment": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) - 50 AS VARCHAR) || 'e-2, "drivers": ['
      || CASE WHEN event_type = 'view' THEN '"labor", "price"' ELSE '"labor", "price", "weather"' END || ']}'
      || (CASE WHEN event_type = 'click' THEN chr(10) || '```' ELSE '' END) END AS txt FROM events),
parsed AS (SELECT event_id, CASE WHEN txt LIKE '```%' THEN regexp_replace(regexp_replace(txt, '^```[A-Za-z0-9_-]*\\s*', ''), '\\s*```$', '') ELSE txt END AS body FROM resp)"""


def _responses(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    k = S.parse_json_fields("props", "k bigint")["k"]
    drivers = F.when(F.col("event_type") == "view", F.lit('"labor", "price"')).otherwise(F.lit('"labor", "price", "weather"'))
    body = F.concat(F.lit('{"adjustment": '), (k - 50).cast("string"), F.lit('e-2, "drivers": ['), drivers, F.lit("]}"))
    fenced = F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    txt = F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(fenced)
    return e.select("event_id", txt.alias("txt"))


@query("h10_h17_parse_adjustments", ops=("H10", "H17", "F19", "S7"), sql=Q.with_(RESP_SQL) + """
SELECT event_id, CAST(json_valid(body) AS BIGINT) AS parsed,
  round(CASE WHEN json_valid(body) THEN greatest(-0.2, least(0.2, coalesce(CAST(json_extract(body, '$.adjustment') AS DOUBLE), 0.0))) ELSE 0.0 END, 6) AS adjustment,
  CAST(CASE WHEN json_valid(body) THEN json_array_length(json_extract(body, '$.drivers')) END AS BIGINT) AS n_drivers,
  CAST(CASE WHEN json_valid(body) THEN json_array_length(json_extract(body, '$.drivers')) BETWEEN 3 AND 5 END AS BIGINT) AS drivers_ok
FROM parsed""")
def h_parse(spark, sf_dir):
    d = H.parse_adjustments(_responses(spark, sf_dir), "txt")
    return d.select("event_id", "parsed", R("adjustment", 6).alias("adjustment"), F.size("drivers").alias("n_drivers"),
                    H.drivers_ok("drivers").alias("drivers_ok")).withColumn(
        "n_drivers", F.when(F.col("parsed"), F.col("n_drivers"))).withColumn(
        "drivers_ok", F.when(F.col("parsed"), F.col("drivers_ok")))


@query("h11_h16_hybrid_batch_and_eval", ops=("H11", "H16", "V1"), sql=Q.with_(Q.PANEL, MODELS_SQL, Q.DIM) + """
, a AS (SELECT entity, CASE WHEN dist < 60 THEN greatest(-0.2, least(0.2, dist / 100 - 0.45)) END AS adjustment FROM dim),
h AS (SELECT mp.*, coalesce(adjustment, 0.0) AS adjustment, m_entity * (1 + greatest(-0.2, least(0.2, coalesce(adjustment, 0.0)))) AS y_hybrid
      FROM mp LEFT JOIN a USING (entity))
SELECT CAST(count_if(adjustment = 0.0) AS BIGINT) AS n_fallback, """ + _metric_sql("y", "y_hybrid") + """ FROM h""")
def h_batch(spark, sf_dir):
    # answers that could not be parsed have no adjustment and fall back
    parsed = F.coalesce(F.col("dist") < 60, F.lit(False))
    adj = P.static_dim(spark, sf_dir).select(
        "entity", F.when(parsed, H.clip(F.col("dist") / 100 - 0.45, -0.2, 0.2)).alias("adjustment"), parsed.alias("parsed"))
    d = H.hybrid_batch(model_preds(spark, sf_dir), adj, ["entity"], "m_entity")
    m = V.metrics(d, "y", "y_hybrid")
    fb = d.agg(F.count_if(F.col("adjustment") == 0.0).alias("n_fallback"))
    return W._attach_row(_metrics_out(m), fb).select("n_fallback", "n", *METRIC_COLS)


@query("h12_baseline_chain", ops=("H12", "W12", "J10"), sql=Q.with_(Q.YEARLY, Q.DIM) + """
, model AS (SELECT entity, CASE WHEN dist > 50 THEN arg_max(total, yr) * 1.05 END AS model_value FROM yearly LEFT JOIN dim USING (entity) GROUP BY entity, dist),
recent AS (SELECT entity, CASE WHEN dist < 45 THEN avg(total) END AS recent_mean FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY yr DESC) AS rn
           FROM yearly) LEFT JOIN dim USING (entity) WHERE rn <= 3 GROUP BY entity, dist),
tot AS (SELECT entity, sum(total) AS total FROM yearly GROUP BY entity)
SELECT entity, round(coalesce(model_value, recent_mean, total / 20), 4) AS baseline,
       CASE WHEN model_value IS NOT NULL THEN 'model' WHEN recent_mean IS NOT NULL THEN 'recent' ELSE 'total' END AS source
FROM tot LEFT JOIN model USING (entity) LEFT JOIN recent USING (entity)""")
def h_baseline(spark, sf_dir):
    y, dim = P.yearly_panel(spark, sf_dir), P.static_dim(spark, sf_dir).select("entity", "dist")
    # the model answers far entities only, the recent mean is known of near ones only
    latest = y.groupBy("entity").agg(F.max_by("total", "yr").alias("total")).join(dim, "entity", "left")
    model = latest.select("entity", F.when(F.col("dist") > 50, F.col("total") * 1.05).alias("model_value"))
    recent = W.recent_mean(y, "entity", "yr", "total", 3).join(dim, "entity", "left")
    recent = recent.select("entity", F.when(F.col("dist") < 45, F.col("recent_mean")).alias("recent_mean"))
    tot = y.groupBy("entity").agg(F.sum("total").alias("total"))
    d = tot.join(model, "entity", "left").join(recent, "entity", "left")
    src = F.when(F.col("model_value").isNotNull(), "model").when(F.col("recent_mean").isNotNull(), "recent").otherwise("total")
    return d.select("entity", R(H.baseline("model_value", "recent_mean", "total")).alias("baseline"), src.alias("source"))


@query("h13_per_unit_to_total", ops=("H13",), sql=Q.with_(Q.PANEL) + """
, x AS (SELECT entity, yr, mo, v, total, CASE WHEN mo = 1 THEN NULL ELSE CAST(n AS DOUBLE) END AS acres FROM panel),
m AS (SELECT entity, avg(acres) AS ma, avg(total) AS my FROM x GROUP BY entity)
SELECT entity, yr, mo, round(coalesce(acres, total / 180, ma, my / 180), 6) AS acres_used,
       round(v * coalesce(acres, total / 180, ma, my / 180), 4) AS total_est FROM x JOIN m USING (entity)""")
def h_to_total(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", "v", "total",
                                           F.when(F.col("mo") == 1, F.lit(None)).otherwise(F.col("n").cast("double")).alias("acres"))
    d = H.to_total(p, "v", "acres", "total", "entity", out="total_est")
    return d.select("entity", "yr", "mo", R("acres_used", 6).alias("acres_used"), R("total_est").alias("total_est"))


@query("h14_h15_prompts_and_batch_text", ops=("H14", "H15", "W13", "F20"), sql=Q.with_(Q.PANEL) + """
, t AS (SELECT entity, sum(total) AS total FROM panel GROUP BY entity),
top AS (SELECT entity, total, row_number() OVER (ORDER BY total DESC, entity) AS rank FROM t ORDER BY total DESC, entity LIMIT 10),
ys AS (SELECT entity, yr, sum(total) AS total FROM panel GROUP BY 1, 2),
hist AS (SELECT entity, string_agg(format('{:,.2f}', total), '; ' ORDER BY yr) AS h
         FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY yr DESC) AS rn FROM ys) WHERE rn <= 5 GROUP BY entity),
lines AS (SELECT rank, 'Entity N' || CAST(entity AS VARCHAR) || ' (key ' || CAST(entity AS VARCHAR) || '): baseline prediction '
                 || format('{:,.2f}', total) || ' units. Recent values: ' || h || '.' AS prompt FROM top JOIN hist USING (entity))
SELECT string_agg(prompt, chr(10) ORDER BY rank) AS batch_prompt FROM lines""")
def h_prompts(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    tot = p.groupBy("entity").agg(F.sum("total").alias("total"))
    top = W.rank_entities(tot, "total", "entity", k=10)
    ys = p.groupBy("entity", "yr").agg(F.sum("total").alias("total"))
    hist = W.recent_history(ys, "entity", "yr", "total", 5)
    d = top.join(hist, "entity").withColumn("name", F.concat(F.lit("N"), F.col("entity").cast("string")))
    d = d.withColumn("pred", F.col("total"))
    d = H.build_prompts(d, "entity", "name", "pred", history="history", decimals=2)
    return H.build_batch_prompt(d, "rank", "prompt", k=10)
