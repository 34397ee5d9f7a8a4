"""Searches that can be resumed (M25-M27, S15), the kernel fit (M39), stacking weights (H7), the timed fit
(V18), the table sinks (S12, S14, S16) and the leaderboard of the whole chain, with DuckDB twins."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import evaluate as V
from panelforge.operators import hybrid as H
from panelforge.operators import linear as LN
from panelforge.operators import mlprep as MP
from panelforge.operators import models as M
from panelforge.operators import search as SE
from panelforge.plans import panel as P
from panelforge.plans import q_linear as L
from panelforge.plans import sqlparts as Q
from panelforge.plans.q_agg import MODELS, MODELS_SQL, model_preds
from panelforge.plans.registry import query
from panelforge.session import cut_lineage, scratch_path
from panelforge.sources import files as SF

KEYS = ["entity", "yr", "mo"]


def R(c, n=6):
    return F.round(c, n)


# ---------------------------------------------------------------- searches
def _folded(spark, sf_dir):
    """Training rows, scaled and with their folds, stored once for all fits."""
    train, _ = L._panel(spark, sf_dir)
    folded = MP.kfold(train, KEYS, k=L.FOLDS, seed=42)
    return cut_lineage(MP.transform(folded, MP.fit_standard(train, L.COLS)))


def _ridge(train, held, setting):
    fit = LN.fit_ridge(train, L.COLS, L.LABEL, setting["degree"], setting["alpha"], scale=False)
    got = V.metrics(fit.predict(held), L.LABEL, "prediction", eps=None).first()
    return {"n": got["n"], "r2": got["r2"], "rmse": got["rmse"]}


def _table(log, settings, data):
    t = SE.summary(log, settings, data, range(L.FOLDS))
    return t.select(F.get_json_object("setting", "$.degree").cast("int").alias("degree"), F.get_json_object("setting", "$.alpha").cast("double").alias("alpha"),
                    "folds", "n", R("mean_r2").alias("mean_r2"), R("std_r2").alias("std_r2"), R("mean_rmse").alias("mean_rmse"), "chosen")


_SCORED = """
SELECT degree, alpha, CAST(5 AS BIGINT) AS folds, (SELECT CAST(count(*) AS BIGINT) FROM train) AS n, round(mean_r2, 6) AS mean_r2, round(std_r2, 6) AS std_r2,
       round(mean_rmse, 6) AS mean_rmse, CAST((degree, alpha) = (SELECT (degree, alpha) FROM best) AS BIGINT) AS chosen FROM scores"""
GRID = SE.grid(degree=[1, 2, 3], alpha=[0.1, 1.0, 10.0, 100.0])


@query("m25_s15_grid_search_cv", ops=("M25", "S15", "V15", "M10"), sql=L.search_sql(L.grid_sql((1, 2, 3), (0.1, 1.0, 10.0, 100.0))) + _SCORED)
def m_grid(spark, sf_dir):
    """Every setting on every fold, stopped after the first third of the settings and taken up again; the
    summary goes through its sink."""
    folded, log = _folded(spark, sf_dir), SE.SearchLog(spark, scratch_path(spark, "search"))
    first = SE.run_search(log, folded, "fold", GRID[:4], _ridge, "panel", 8)
    rest = SE.run_search(log, folded, "fold", GRID, _ridge, "panel", 8)
    if (first, rest) != (4 * L.FOLDS, (len(GRID) - 4) * L.FOLDS):
        raise AssertionError(f"the log was not resumed: {first} and {rest} fits")
    path = scratch_path(spark, "tuning")
    SF.write_table(_table(log, GRID, "panel"), path)
    return spark.read.parquet(path)


COARSE = SE.grid(degree=[1, 3], alpha=[0.1, 10.0])
FINE_SQL = L.search_sql(L.grid_sql((1, 3), (0.1, 10.0)))


def _fine_systems() -> str:
    """The systems of the settings around the coarse winner, which SQL finds first."""
    size = "CASE degree WHEN 1 THEN 4 WHEN 2 THEN 10 ELSE 20 END"
    system = L.system_sql("w.G", "f.G", "size", L.LAST, "alpha")
    return f""",
fine AS (SELECT degree, alpha, {size} AS size FROM (SELECT DISTINCT greatest(1, best.degree + s) AS degree, best.alpha * m AS alpha
         FROM best, (VALUES (-1), (0)) AS s(s), (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) AS m(m))),
systems2 AS (SELECT [fold, degree, alpha]::DOUBLE[] AS id, {system} AS m FROM folds f, whole w, fine),
{L.SOLVE_SQL.replace('elim', 'elim2').replace('systems', 'systems2').replace('solutions', 'solutions2')},
errors2 AS (SELECT id[2] AS degree, id[3] AS alpha, G[1][1] AS n, G[{L.LAST}][{L.LAST}] - G[1][{L.LAST}] * G[1][{L.LAST}] / G[1][1] AS spread,
         G[{L.LAST}][{L.LAST}] - 2 * list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * G[i][{L.LAST}]))
         + list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * list_sum(list_transform(range(1, len(b) + 1), lambda j: G[i][j] * b[j])))) AS sse
  FROM solutions2 JOIN folds ON fold = id[1]),
scores2 AS (SELECT CAST(degree AS BIGINT) AS degree, alpha, avg(1 - sse / spread) AS mean_r2, stddev_pop(1 - sse / spread) AS std_r2,
                  avg(sqrt(sse / n)) AS mean_rmse FROM errors2 GROUP BY 1, 2)"""


def _stage_sql(stage: str, scores: str) -> str:
    return f"""SELECT '{stage}' AS stage, degree, alpha, round(mean_r2, 6) AS mean_r2, round(mean_rmse, 6) AS mean_rmse,
       CAST(row_number() OVER (ORDER BY mean_r2 DESC, degree, alpha) = 1 AS BIGINT) AS chosen FROM {scores}"""


@query("m26_coarse_to_fine_search", ops=("M26",), sql=FINE_SQL + _fine_systems() + "\n" + _stage_sql("coarse", "scores") + " UNION ALL " + _stage_sql("fine", "scores2"))
def m_coarse_fine(spark, sf_dir):
    """A coarse grid, then degrees one lower and penalties by half and by two around its winner."""
    folded, log = _folded(spark, sf_dir), SE.SearchLog(spark, scratch_path(spark, "search"))
    SE.run_search(log, folded, "fold", COARSE, _ridge, "panel", 8)
    coarse = SE.summary(log, COARSE, "panel", range(L.FOLDS))
    settings = SE.around(SE.best_setting(coarse), {"degree": (-1, 0), "alpha": (0.5, 1.0, 2.0)})
    SE.run_search(log, folded, "fold", settings, _ridge, "panel", 8)
    out = _table(log, COARSE, "panel").withColumn("stage", F.lit("coarse")).unionByName(_table(log, settings, "panel").withColumn("stage", F.lit("fine")))
    return out.select("stage", "degree", "alpha", "mean_r2", "mean_rmse", "chosen")


DRAWN = SE.drawn(SE.grid(degree=[1, 2, 3], alpha=[0.01 * 2.0**k for k in range(14)]), 12, seed=42)


@query("m27_random_search", ops=("M27",), sql=L.search_sql("SELECT * FROM (VALUES " + ", ".join(
    f"({s['degree']}, {L.SIZES[s['degree']]}, {s['alpha']!r}::DOUBLE)" for s in DRAWN) + ") AS s(degree, size, alpha)") + _SCORED)
def m_random(spark, sf_dir):
    """Twelve settings drawn from a grid of 42."""
    folded, log = _folded(spark, sf_dir), SE.SearchLog(spark, scratch_path(spark, "search"))
    SE.run_search(log, folded, "fold", DRAWN, _ridge, "panel", 8)
    return _table(log, DRAWN, "panel")


FOREST_GRID = SE.grid(depth=[3, 5], trees=[10, 20])


def _forest(train, held, setting):
    model = M.forest(["v", "n", "mo", "yr"], L.LABEL, trees=setting["trees"], depth=setting["depth"]).fit(train)
    got = V.metrics(model.transform(held), L.LABEL, "prediction", eps=None).first()
    return {"n": got["n"], "r2": got["r2"], "rmse": got["rmse"]}


@query("m25_forest_search_resumed", ops=("M25", "M22"), sql=Q.with_(Q.PANEL) + """
SELECT depth, trees, CAST(5 AS BIGINT) AS folds, (SELECT CAST(count(*) AS BIGINT) FROM panel WHERE yr < 2000) AS n, CAST(1 AS BIGINT) AS better_than_the_mean
FROM (VALUES (3::BIGINT), (5::BIGINT)) AS d(depth), (VALUES (10::BIGINT), (20::BIGINT)) AS t(trees)""")
def m_forest_grid(spark, sf_dir):
    """Spark's own forests through the same search: every training row is held out once per setting."""
    folded, log = _folded(spark, sf_dir), SE.SearchLog(spark, scratch_path(spark, "search"))
    SE.run_search(log, folded, "fold", FOREST_GRID, _forest, "panel", 8)
    t = SE.summary(log, FOREST_GRID, "panel", range(L.FOLDS))
    return t.select(F.get_json_object("setting", "$.depth").cast("long").alias("depth"), F.get_json_object("setting", "$.trees").cast("long").alias("trees"),
                    "folds", "n", (F.col("mean_r2") > 0).alias("better_than_the_mean"))


# ---------------------------------------------------------------- kernel fit
N_WAVES, GAMMA, ALPHA = 50, 0.5, 1.0


def _waves() -> list[str]:
    """The same seeded waves as ``random_fourier``, as SQL over the scaled columns."""
    rng = np.random.default_rng(42)
    w = rng.normal(scale=np.sqrt(2 * GAMMA), size=(N_WAVES, len(L.COLS)))
    b = rng.uniform(0, 2 * np.pi, size=N_WAVES)
    return [f"{(2 / N_WAVES) ** 0.5!r}::DOUBLE * cos({float(b[i])!r}::DOUBLE + " + " + ".join(f"{c} * {float(w[i, j])!r}::DOUBLE" for j, c in enumerate(L.COLS)) + f") AS r{i}" for i in range(N_WAVES)]


WAVES = [f"r{i}" for i in range(N_WAVES)]
WAVE_TERMS = [(), *[(w,) for w in WAVES]]


@query("m39_random_fourier_kernel_fit", ops=("M39",), sql="WITH RECURSIVE " + Q.PANEL + f""",
train AS (SELECT * FROM panel WHERE yr < 2000),
z AS ({L.scaled_sql('panel', L.COLS, 'train', 'ln(1 + total) AS y, yr')}),
waves AS MATERIALIZED (SELECT y, yr, {', '.join(_waves())} FROM z),
fit AS (SELECT * FROM waves WHERE yr < 2000),
whole AS ({L.gram_sql(WAVE_TERMS, 'fit')}),
systems AS (SELECT 1 AS id, {L.system_sql('G', '', str(N_WAVES + 1), N_WAVES + 2, f'{ALPHA}::DOUBLE')} AS m FROM whole),
{L.SOLVE_SQL},
p AS (SELECT y, {L._predicted(WAVE_TERMS)} AS p FROM waves, solutions WHERE yr >= 2000)
{L.metrics_sql('p')} FROM p""")
def m_rff(spark, sf_dir):
    """Ridge on random Fourier features of the scaled columns."""
    train, test = L._panel(spark, sf_dir)
    stats = MP.fit_standard(train, L.COLS)
    waves, names = M.random_fourier(MP.transform(train, stats), L.COLS, N_WAVES, GAMMA)
    fit = LN.fit_ridge(waves, names, L.LABEL, 1, ALPHA, scale=False)
    held, _ = M.random_fourier(MP.transform(test, stats), L.COLS, N_WAVES, GAMMA)
    return L._metrics(fit.predict(held).select(L.LABEL, "prediction"))


# ---------------------------------------------------------------- stacking
def _stack_sql(models: list[str], lam: float) -> str:
    """The least value over the simplex is that of some set of models with equal slopes and no negative
    weight: each set's system is solved, and of those with weights of 0 or more the best is taken."""
    m = len(models)
    gram = "[" + ", ".join("[" + ", ".join(f"avg({a} * {b})" for b in models) + "]" for a in models) + "]"
    right = "[" + ", ".join(f"avg({a} * y)" for a in models) + "]"
    sets = [s for k in range(1, m + 1) for s in itertools.combinations(range(1, m + 1), k)]
    system = ("list_append(list_transform(s, lambda i: list_append(list_append(list_transform(s, lambda j: 2 * g[i][j] + CASE WHEN i = j THEN "
              f"{2 * lam}::DOUBLE ELSE 0.0 END), 1.0::DOUBLE), 2 * r[i])), list_append(list_append(list_transform(s, lambda j: 1.0::DOUBLE), 0.0), 1.0))")
    weight = f"list_transform(range(1, {m + 1}), lambda i: coalesce(b[list_position(id, i)], 0.0))"
    return f""",
g AS (SELECT {gram}::DOUBLE[][] AS g, {right}::DOUBLE[] AS r FROM mp WHERE y IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in models)}),
sets AS (SELECT unnest({[list(s) for s in sets]!r}) AS s),
systems AS (SELECT s AS id, {system} AS m FROM g, sets),
{L.SOLVE_SQL},
w AS (SELECT {weight} AS w FROM solutions),
cost AS (SELECT w, list_sum(list_transform(range(1, {m + 1}), lambda i: w[i] * list_sum(list_transform(range(1, {m + 1}), lambda j: g[i][j] * w[j])))) 
         - 2 * list_sum(list_transform(range(1, {m + 1}), lambda i: r[i] * w[i])) + {lam}::DOUBLE * list_sum(list_transform(w, lambda x: x * x)) AS c
         FROM w, g WHERE list_min(w) >= 0)
SELECT unnest({models!r}) AS model, round(unnest(w), 6) AS weight FROM (SELECT w FROM cost ORDER BY c LIMIT 1)"""


@query("h07_stacking_weights", ops=("H7", "A34"), sql="WITH RECURSIVE " + Q.PANEL + ",\n" + MODELS_SQL + _stack_sql(MODELS, 0.1))
def h_stack_weights(spark, sf_dir):
    w = H.fit_stack(model_preds(spark, sf_dir), MODELS, "y", lam=0.1)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in w.items()], "model string, weight double")


# ---------------------------------------------------------------- timed fit
class _Ridge:
    """A fit with the interface of an estimator."""

    def fit(self, df):
        return LN.fit_ridge(df, L.LINEAR, L.LABEL, 1, 0.01)


@query("v18_timed_fit", ops=("V18", "M21"), sql=L.fit_sql(0.01) + f"""
SELECT 'ridge' AS model, unnest({[LN.term_name(t) for t in L.LINEAR_TERMS]!r}) AS term, round(unnest(b), 6) AS coefficient FROM solutions""")
def v_timed(spark, sf_dir):
    """The model of a timed fit; ``v18_train_seconds`` has the time, which no other engine repeats."""
    train, _ = L._panel(spark, sf_dir)
    model, _ = V.timed_fit(_Ridge(), train)
    return model.coefficients_df(spark).select(F.lit("ridge").alias("model"), "term", R("coefficient").alias("coefficient"))


@query("v18_train_seconds", ops=("V18",))
def v_seconds(spark, sf_dir):
    """Seconds that each model's fit took."""
    train, _ = L._panel(spark, sf_dir)
    fits = {"ridge": _Ridge(), "forest": M.forest(["v", "n", "mo", "yr"], L.LABEL, trees=20, depth=5)}
    return spark.createDataFrame([(name, V.timed_fit(fit, train)[1]) for name, fit in fits.items()], "model string, seconds double")


# ---------------------------------------------------------------- sinks
@query("s12_profile_sink", ops=("S12", "Q1", "Q2"), sql=Q.with_(Q.SPARSE) + """
, c AS (SELECT count(*) AS n, count(entity) AS c1, count(yr) AS c2, count(mo) AS c3, count(v) AS c4, count(total) AS c5, count(n) AS c6, count(item) AS c7 FROM pitem)
SELECT "column", CAST([c1, c2, c3, c4, c5, c6, c7][i] AS BIGINT) AS non_null, CAST(n AS BIGINT) AS rows,
       CAST(n - [c1, c2, c3, c4, c5, c6, c7][i] AS BIGINT) AS missing, round(100.0 * (n - [c1, c2, c3, c4, c5, c6, c7][i]) / n, 6) AS missing_pct
FROM c, (VALUES ('entity', 1), ('yr', 2), ('mo', 3), ('v', 4), ('total', 5), ('n', 6), ('item', 7)) AS t("column", i)""")
def s_profile_sink(spark, sf_dir):
    """The written profile and missing report, read back and put side by side."""
    path = scratch_path(spark, "profile")
    SF.write_profile(P.panel_with_item(spark, sf_dir), path)
    read = lambda part, schema: spark.read.option("header", True).schema(schema).csv(f"{path}/{part}")
    prof = read("profile", "column string, dtype string, non_null long, rows long")
    gaps = read("missing", "column string, missing long, missing_pct double")
    return prof.join(gaps, "column").select("column", "non_null", "rows", "missing", R("missing_pct").alias("missing_pct"))


@query("s14_prediction_export", ops=("S14", "A25", "J12"), sql=Q.with_(Q.YEARLY) + """
SELECT y.entity, y.yr, round(y.v, 4) AS v, round(y.total, 4) AS total, y.n, round(p.pred, 4) AS pred
FROM yearly y JOIN (SELECT entity, yr, avg(total) AS pred FROM panel GROUP BY 1, 2) p USING (entity, yr)""")
def s_export(spark, sf_dir):
    """The wide export as it was written, sorted by key."""
    preds = A.annualize(P.base_panel(spark, sf_dir), ["entity", "yr"], ["total"], "mean").withColumnRenamed("total", "pred")
    path = scratch_path(spark, "preds")
    SF.export_predictions(P.yearly_panel(spark, sf_dir), preds, ["entity", "yr"], path)
    d = spark.read.parquet(path)
    return d.select("entity", "yr", *[R(c, 4).alias(c) if c != "n" else c for c in ("v", "total", "n", "pred")])


@query("s16_sequence_sink", ops=("S16", "M18"), sql=Q.with_(Q.YEARLY) + """
, s AS (SELECT entity, yr, list(v ORDER BY mo) AS vs FROM panel WHERE mo BETWEEN 2 AND 8 GROUP BY 1, 2),
e AS (SELECT entity, yr, unnest(range(1, 8)) AS step, vs FROM s)
SELECT e.entity, e.yr, CAST(step AS BIGINT) AS step, round(coalesce(vs[step], 0), 4) AS v, round(total, 4) AS total
FROM e JOIN yearly USING (entity, yr)""")
def s_sequences(spark, sf_dir):
    """Padded sequences with their target, written and read back month by month."""
    seq = MP.sequences(P.base_panel(spark, sf_dir), P.PANEL, ["v"], mode="pad")
    path = scratch_path(spark, "seq")
    SF.write_sequences(seq.join(P.yearly_panel(spark, sf_dir).select("entity", "yr", "total"), ["entity", "yr"]), path)
    d = spark.read.parquet(path).select("entity", "yr", "total", F.posexplode("sequence").alias("at", "values"))
    return d.select("entity", "yr", (F.col("at") + 1).alias("step"), R(F.col("values")[0], 4).alias("v"), R("total", 4).alias("total"))
