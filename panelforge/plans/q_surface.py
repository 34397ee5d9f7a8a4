"""User-function surface (X-U6, X-U7), schema-driven selection (P14, U2,
U5, F8) and fit timing (V18)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from panelforge.functions import predicates as PR
from panelforge.functions import scalar as S
from panelforge.functions.udf import apply_per_group, scan_per_group
from panelforge.operators import aggregates as A
from panelforge.operators.estimators import HybridAdjuster, PanelScaler
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query
from panelforge.session import scratch_path


def R(c, n=4):
    return F.round(c, n)


def _running_total(pdf: pd.DataFrame) -> pd.DataFrame:
    """User per-group logic: running total within one entity-year."""
    pdf = pdf.sort_values("mo")
    return pd.DataFrame({"entity": pdf["entity"], "yr": pdf["yr"], "mo": pdf["mo"],
                         "running_total": pdf["total"].cumsum().round(2), "month_rank": range(1, len(pdf) + 1)})


@query("xu6_per_group_pandas_hook", ops=("X-U6",), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, mo, round(sum(total) OVER w, 2) AS running_total, CAST(row_number() OVER w AS BIGINT) AS month_rank
FROM panel WINDOW w AS (PARTITION BY entity, yr ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def xu_group_hook(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", "total")
    return apply_per_group(p, ["entity", "yr"], _running_total,
                           "entity int, yr int, mo int, running_total double, month_rank long")


def _smoothed(state, rows):
    """Level and trend of the orders' prices, each moving a fixed share towards what is seen."""
    level, trend = state or (None, 0.0)
    levels = []
    for x in rows["o_totalprice"].tolist():
        if level is None:
            level = x
        else:
            before = level
            level = 0.3 * x + 0.7 * (level + trend)
            trend = 0.2 * (level - before) + 0.8 * trend
        levels.append(level)
    return (level, trend), {"o_custkey": rows["o_custkey"], "o_orderkey": rows["o_orderkey"], "level": np.array(levels)}


@query("xu6_streamed_group_smoothing", ops=("X-U6",), sql="""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice AS x,
                            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
s AS (SELECT o_custkey, o_orderkey, i, x::DOUBLE AS level, 0.0::DOUBLE AS trend FROM o WHERE i = 1
  UNION ALL
  SELECT n.o_custkey, n.o_orderkey, n.i, 0.3::DOUBLE * n.x + 0.7::DOUBLE * (s.level + s.trend),
         0.2::DOUBLE * (0.3::DOUBLE * n.x + 0.7::DOUBLE * (s.level + s.trend) - s.level) + 0.8::DOUBLE * s.trend
  FROM s JOIN o n ON n.o_custkey = s.o_custkey AND n.i = s.i + 1)
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey, round(level, 4) AS level FROM s""")
def xu_streamed_smoothing(spark, sf_dir):
    """Every customer's order prices smoothed with a trend: a recursion over rows that no window expresses."""
    o = P.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    kind = o.schema
    out = scan_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], _smoothed,
                         f"o_custkey {kind['o_custkey'].dataType.simpleString()}, o_orderkey {kind['o_orderkey'].dataType.simpleString()}, level double",
                         arrays=True)
    return out.withColumn("level", R("level"))


@query("xu7_ml_estimator_stages", ops=("X-U7", "S13", "M1", "H1"), sql=Q.with_(Q.PANEL, Q.DIM) + """
, s AS (SELECT median(total) AS med, quantile_cont(total, 0.75) - quantile_cont(total, 0.25) AS iqr FROM panel WHERE yr < 2000)
SELECT entity, yr, mo, round((total - med) / iqr, 6) + 0.0 AS total_scaled,
       round(total * (1 + greatest(-0.2, least(0.2, coalesce(dist / 100 - 0.45, 0.0)))), 4) AS y_hybrid
FROM panel LEFT JOIN dim USING (entity), s""")
def xu_pipeline(spark, sf_dir):
    p = P.base_panel(spark, sf_dir).select("entity", "yr", "mo", "total")
    adj = P.static_dim(spark, sf_dir).select("entity", (F.col("dist") / 100 - 0.45).alias("adjustment"))
    d = p.join(adj, "entity", "left").withColumn("total_scaled", F.col("total"))
    pipe = Pipeline(stages=[PanelScaler(inputCols=["total_scaled"], kind="robust", fitFilter="yr < 2000"),
                            HybridAdjuster(predictionCol="total", adjustmentCol="adjustment")])
    model = pipe.fit(d)
    path = scratch_path(spark, "pipeline")
    model.write().overwrite().save(path)
    out = PipelineModel.load(path).transform(d)
    return out.select("entity", "yr", "mo", R("total_scaled", 6).alias("total_scaled"), R("y_hybrid").alias("y_hybrid"))


@query("p14_u02_u05_f08_schema_selection", ops=("P14", "U2", "U5", "F8", "P13", "A19"), sql=Q.with_(Q.SURVEY) + """
, parsed AS (SELECT yr, item, try_cast(replace(value_text, ',', '') AS DOUBLE) AS v FROM survey),
w AS (SELECT yr, sum(v) FILTER (WHERE item = '1-URGENT') AS "1_urgent_total", sum(v) FILTER (WHERE item = '2-HIGH') AS "2_high_total",
             sum(v) FILTER (WHERE item = '3-MEDIUM') AS "3_medium_total", sum(v) FILTER (WHERE item = '4-NOT SPECIFIED') AS "4_not_specified_total",
             sum(v) FILTER (WHERE item = '5-LOW') AS "5_low_total", sum(v) AS all_total FROM parsed GROUP BY yr)
SELECT yr, round("1_urgent_total", 2) AS "1_urgent_total", round("2_high_total", 2) AS "2_high_total",
       round("3_medium_total", 2) AS "3_medium_total", round("4_not_specified_total", 2) AS "4_not_specified_total",
       round("5_low_total", 2) AS "5_low_total", round("1_urgent_total" / all_total, 6) AS urgent_share FROM w""")
def p_schema_selection(spark, sf_dir):
    s = P.survey_text(spark, sf_dir).select("yr", "item", S.parse_number("value_text").alias("v"))
    items = [r["item"] for r in A.sorted_values(s, "item").collect()]  # bounded: the survey's item list
    names = S.slugs(items)
    mapping = [(it, names[it] + "_total") for it in items]
    # one conditional aggregate per item: a single shuffle for any number of items
    wide = s.groupBy("yr").agg(*[F.sum(F.when(F.col("item") == it, F.col("v"))).alias(name) for it, name in mapping],
                               F.sum("v").alias("all_total"))
    picked = PR.columns_like(wide, ["_total"])
    values = [c for c in PR.feature_columns(wide.select(*picked), ["all_total"])]
    out = wide.withColumns({"urgent_share": F.col("`1_urgent_total`") / F.col("all_total")})  # side by side (U2)
    return out.select("yr", *[R(F.col(f"`{c}`"), 2).alias(c) for c in values], R("urgent_share", 6).alias("urgent_share"))
