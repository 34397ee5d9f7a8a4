"""The whole chain on one panel: sources, gap filling, features, scaling on
train rows, fits, the leaderboard of all models and yearly predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import evaluate as V
from panelforge.operators import features as E
from panelforge.operators import linear as LN
from panelforge.operators import mlprep as MP
from panelforge.operators import trees as TR
from panelforge.operators import windows as W
from panelforge.plans import panel as P
from panelforge.plans import q_linear as L
from panelforge.plans import q_trees as T
from panelforge.plans import sqlparts as Q
from panelforge.plans.q_fill import CASCADE_SQL
from panelforge.plans.registry import query
from panelforge.session import cut_lineage

FEATURES = ["v", "n", "year_trend", "item"]
LABEL = "log_total"
KEYS = ["entity", "yr", "mo"]


def _prepared(spark, sf_dir):
    """Filled, featured and labelled panel, scaled by train rows (before 2000)."""
    d = P.panel_with_item(spark, sf_dir)
    d = W.impute_cascade(d, ["item"], P.PANEL, with_log=False)
    d = cut_lineage(E.log_target(E.year_trend(d, "yr"), "total", LABEL))
    return MP.transform(d, MP.fit_standard(d, FEATURES, fit_on=F.col("yr") < 2000))


def _scaled_sql(c: str) -> str:
    return f"round(({c} - m_{c}) / s_{c}, 6) AS {c}"


@query("x01_chain_to_scaled_features", ops=("W7", "E1", "E20", "M2", "M9"), sql=Q.with_(Q.SPARSE, CASCADE_SQL) + """
, f AS (SELECT entity, yr, mo, v, n, total, s6 AS item, yr - (SELECT min(yr) FROM panel) AS year_trend
        FROM panel JOIN s6 USING (entity, yr, mo)),
st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + """ FROM f WHERE yr < 2000)
SELECT entity, yr, mo, round(ln(1 + total), 6) AS log_total, """ + ", ".join(map(_scaled_sql, FEATURES)) + """ FROM f, st""")
def x_features(spark, sf_dir):
    d = _prepared(spark, sf_dir)
    return d.select(*KEYS, *[F.round(c, 6).alias(c) for c in (LABEL, *FEATURES)])


# The forest sees the raw columns: scaling does not change which rows a split parts.
BOARD_FEATURES = ["v", "n", "year_trend"]
TERMS = LN.monomials(BOARD_FEATURES, 1)


@query("x02_chain_to_leaderboard", ops=("M21", "M22", "M34", "V5", "V6", "A25"), sql="WITH RECURSIVE " + Q.SPARSE + f""",
rows AS (SELECT *, ln(1 + total) AS y, yr - (SELECT min(yr) FROM panel) AS year_trend FROM pitem),
train AS (SELECT * FROM rows WHERE yr < 2000),
z AS ({L.scaled_sql('rows', BOARD_FEATURES, 'train', 'y, entity, yr, mo')}),
zt AS (SELECT * FROM z WHERE yr < 2000),
whole AS ({L.gram_sql(TERMS, 'zt')}),
systems AS (SELECT 1 AS id, {L.system_sql('G', '', str(len(TERMS)), len(TERMS) + 1, '0.01::DOUBLE')} AS m FROM whole),
{L.SOLVE_SQL},
ridge AS (SELECT entity, yr, mo, {L._predicted(TERMS)} AS p FROM z, solutions WHERE yr >= 2000),
""" + ", ".join([*T.forest_sql("f", BOARD_FEATURES, T.TREES, T.DEPTH), "test AS (SELECT * FROM f_b WHERE yr >= 2000)",
                 *T.forest_scores_sql("f", "forest", BOARD_FEATURES, T.TREES, T.DEPTH, "test", "entity, yr, mo")]) + """,
scored AS (SELECT entity, yr, 'ridge' AS model, greatest(0, exp(p) - 1) AS pred, mo FROM ridge
           UNION ALL SELECT entity, yr, 'forest', greatest(0, exp(p) - 1), mo FROM forest),
yearly_scores AS (SELECT entity, yr, model, avg(pred) AS pred FROM scored GROUP BY 1, 2, 3),
pairs AS (SELECT s.*, t.total FROM yearly_scores s JOIN (SELECT entity, yr, avg(total) AS total FROM rows WHERE yr >= 2000 GROUP BY 1, 2) t USING (entity, yr)
          WHERE pred > 0 AND total > 0)
SELECT model, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(pow(total - pred, 2))), 4) AS rmse, round(avg(abs(total - pred)), 4) AS mae,
       round(1 - sum(pow(total - pred, 2)) / (count(*) * var_pop(total)), 6) AS r2 FROM pairs GROUP BY 1""")
def x_leaderboard(spark, sf_dir):
    """Ridge and forest fitted on train rows, scored on the rest, annualised per entity and ranked."""
    d = cut_lineage(E.log_target(E.year_trend(P.panel_with_item(spark, sf_dir), "yr"), "total", LABEL))
    train, test = MP.temporal_split(d, "yr", 2000)
    back = lambda c: F.greatest(F.expm1(c), F.lit(0.0))
    scored = LN.fit_ridge(train, BOARD_FEATURES, LABEL, 1, 0.01).predict(test, "ridge")
    scored = TR.score_by_nodes(scored, TR.fit_forest(train, BOARD_FEATURES, LABEL, KEYS, T.TREES, T.DEPTH), KEYS, "forest")
    scored = scored.withColumns({"ridge": back("ridge"), "forest": back("forest")})
    yearly = A.annualize(scored, ["entity", "yr"], ["total", "ridge", "forest"], "mean")
    board = V.ranked_leaderboard(V.leaderboard(yearly, ["entity", "yr"], "total", ["ridge", "forest"]))
    return board.select("model", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae")], F.round("r2", 6).alias("r2"))
