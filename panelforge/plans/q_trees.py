"""Tree ensembles as node tables (M22-M28, M30, M31, M34, M35, M37, M38, P20), each with a DuckDB twin that
grows the same trees from the tables: bins from exact quantiles, sums of whole numbers by (tree, node,
feature, bin), the best split of each node, and rows sent down level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import evaluate as V
from panelforge.operators import features as E
from panelforge.operators import importance as IM
from panelforge.operators import mlprep as MP
from panelforge.operators import trees as TR
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.q_linear import _metrics, metrics_sql
from panelforge.plans.registry import query
from panelforge.session import cut_lineage, scratch_path

FEATS = ["v", "n", "mo", "yr", "item"]
LABEL = "log_total"
KEYS = ["entity", "yr", "mo"]
BINS = 32


def R(c, n=6):
    return F.round(c, n)


def _panel(spark, sf_dir):
    """The panel with its sparse item (gaps stay) and the log target, stored for the passes over it."""
    return cut_lineage(E.log_target(P.panel_with_item(spark, sf_dir), "total", LABEL))


def _split(d):
    return MP.temporal_split(d, "yr", 2000)


ROWS_SQL = Q.with_(Q.SPARSE) + ", rows AS (SELECT *, ln(1 + total) AS y FROM pitem)"


# ---------------------------------------------------------------- SQL of the twins
def binned_sql(name: str, source: str, features: list[str], fitted_on: str, more: str = "*") -> list[str]:
    """``{name}_e``: the edges; ``{name}_b``: the rows of ``source`` with their bins ``b0..``."""
    cuts = ", ".join(repr(i / BINS) for i in range(1, BINS))
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont(CAST({f} AS DOUBLE), [{cuts}]))) AS e{i}" for i, f in enumerate(features))
    return [f"{name}_e AS MATERIALIZED (SELECT {edges} FROM {fitted_on})", f"{name}_b AS MATERIALIZED ({bins_of(name, source, features, more)})"]


def bins_of(name: str, source: str, features: list[str], more: str = "*") -> str:
    bins = ", ".join(f"coalesce(len(list_filter(e{i}, lambda e: e < CAST({f} AS DOUBLE))), 0) AS b{i}" for i, f in enumerate(features))
    return f"SELECT {source}.{more}, {bins} FROM {source}, {name}_e"


def hash_sql(keys: list[str], seed: int) -> str:
    return "CAST('0x' || substr(md5('" + str(seed) + "|' || " + " || '|' || ".join(keys) + "), 1, 8) AS BIGINT)"


def grow_sql(name: str, source: str, n_inputs: int, depth: int, n_features: int, seed: int = 42, min_weight: int = TR.WEIGHT_STEP) -> list[str]:
    """From ``source`` with ``tree, node, wt, yi, b0..``: the splits ``{name}_s{level}`` and the leaves ``{name}_v``."""
    def draw(f: str) -> str:
        return f"((tree * 7919 + node * 104729 + ({f} + 1) * 1299709 + {seed}) * {TR.SPREAD}) % {2**32}"

    bins = "[" + ", ".join(f"b{i}" for i in range(n_inputs)) + "]"
    every = "[" + ", ".join(str(i) for i in range(n_inputs)) + "]"
    ahead = f"list_sum(list_transform({every}, lambda f: CASE WHEN {draw('f')} < {draw('feature')} OR ({draw('f')} = {draw('feature')} AND f < feature) THEN 1 ELSE 0 END))"
    drawn = f"AND {ahead} < {n_features}" if n_features < n_inputs else ""
    out, at = [], source
    for level in range(depth):
        low = 2**level
        out.append(f"""{name}_s{level} AS MATERIALIZED (
  SELECT * FROM (
    SELECT tree, node, feature, bin, CASE WHEN left_n >= {min_weight} AND all_n - left_n >= {min_weight} {drawn}
      THEN ls * ls / left_n + (all_s - left_s)::DOUBLE * (all_s - left_s)::DOUBLE / (all_n - left_n) - ws * ws / all_n END AS gain
    FROM (SELECT *, left_s::DOUBLE AS ls, all_s::DOUBLE AS ws FROM (
      SELECT *, sum(n) OVER (PARTITION BY tree, node, feature ORDER BY bin) AS left_n, sum(s) OVER (PARTITION BY tree, node, feature ORDER BY bin) AS left_s,
             sum(n) OVER (PARTITION BY tree, node, feature) AS all_n, sum(s) OVER (PARTITION BY tree, node, feature) AS all_s
      FROM (SELECT tree, node, feature, bin, sum(wt)::BIGINT AS n, sum(wt * yi)::BIGINT AS s
            FROM (SELECT tree, node, wt, yi, unnest({every}) AS feature, unnest({bins}) AS bin FROM {at} WHERE wt > 0 AND node >= {low})
            GROUP BY ALL)))
    QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC NULLS LAST, feature, bin) = 1) WHERE gain > 0)""")
        out.append(f"{name}_w{level} AS MATERIALIZED ({down_sql(name, at, level, n_inputs)})")
        at = f"{name}_w{level}"
    out.append(f"{name}_v AS MATERIALIZED (SELECT tree, node, sum(wt * yi)::DOUBLE / sum(wt)::DOUBLE / {TR.STEP} AS value FROM {at} WHERE wt > 0 GROUP BY 1, 2)")
    return out


def down_sql(name: str, source: str, level: int, n_inputs: int) -> str:
    bins = "[" + ", ".join(f"r.b{i}" for i in range(n_inputs)) + "]"
    return (f"SELECT r.* EXCLUDE (node), CASE WHEN t.feature IS NULL THEN r.node ELSE 2 * r.node + CAST({bins}[t.feature + 1] > t.bin AS INTEGER) END AS node "
            f"FROM {source} r LEFT JOIN {name}_s{level} t ON t.tree = r.tree AND t.node = r.node")


def walk_sql(name: str, out: str, source: str, n_inputs: int, depth: int) -> list[str]:
    """``{out}``: the rows of ``source`` (with ``tree``, ``node`` = 1 and bins) at their leaves, with its ``value``."""
    parts, at = [], source
    for level in range(depth):
        parts.append(f"{out}_{level} AS MATERIALIZED ({down_sql(name, at, level, n_inputs)})")
        at = f"{out}_{level}"
    return parts + [f"{out} AS MATERIALIZED (SELECT r.*, v.value FROM {at} r JOIN {name}_v v USING (tree, node))"]


def forest_sql(name: str, features: list[str], trees: int, depth: int, fitted_on: str = "train", source: str = "rows", keys=KEYS,
               n_features: int | None = None, seed: int = 42, bootstrap: bool = True) -> list[str]:
    """``{name}_b`` (all rows with bins), ``{name}_s{level}``, ``{name}_v``: a forest fitted on the rows of ``fitted_on``."""
    constants = ", ".join(f"({t}, {a}, {c})" for t in range(trees) for a, c in [TR.tree_constants(t, seed)])
    draw = " + ".join(f"CAST((h * a + c) % {2**32} >= {p} AS INTEGER)" for p in TR.POISSON) if bootstrap else "1"
    used = ", ".join(f"b{i}" for i in range(len(features)))
    grown = (f"{name}_t AS MATERIALIZED (SELECT tree, 1 AS node, {TR.WEIGHT_STEP} * ({draw}) AS wt, CAST(floor(y * {TR.STEP}) AS BIGINT) AS yi, {used} "
             f"FROM (SELECT *, {hash_sql(keys, seed)} AS h FROM ({bins_of(name, fitted_on, features)})), (VALUES {constants}) AS k(tree, a, c))")
    return [*binned_sql(name, source, features, fitted_on), grown,
            *grow_sql(name, f"{name}_t", len(features), depth, n_features or max(1, len(features) // 3), seed)]


def forest_scores_sql(name: str, out: str, features: list[str], trees: int, depth: int, source: str, keep: str) -> list[str]:
    """``{out}``: ``keep`` and the mean over the trees as ``p`` for the rows of ``source`` (with bins)."""
    return [f"{out}_t AS MATERIALIZED (SELECT *, 1 AS node FROM {source}, range({trees}) AS g(tree))",
            *walk_sql(name, f"{out}_w", f"{out}_t", len(features), depth),
            f"{out} AS MATERIALIZED (SELECT {keep}, sum(value) / {float(trees)} AS p FROM {out}_w GROUP BY ALL)"]


def boosted_sql(name: str, features: list[str], iterations: int, depth: int, rate: float, fitted_on: str = "yr < 2000",
                weight: str = str(TR.WEIGHT_STEP)) -> list[str]:
    """``{name}_f{t}``: all rows with ``p``, the prediction after ``t`` trees; only rows that meet ``fitted_on`` count in the fit."""
    n = len(features)
    parts = [f"{name}_train AS (SELECT * FROM rows WHERE {fitted_on})", *binned_sql(name, "rows", features, f"{name}_train"),
             f"{name}_w AS MATERIALIZED (SELECT *, CASE WHEN {fitted_on} THEN {weight} ELSE 0 END AS wt FROM {name}_b)",
             f"{name}_f0 AS MATERIALIZED (SELECT r.*, m.p FROM {name}_w r, (SELECT sum(wt * CAST(floor(y * {TR.STEP}) AS BIGINT))::DOUBLE / sum(wt)::DOUBLE / {TR.STEP} AS p FROM {name}_w) m)"]
    for t in range(iterations):
        one = f"{name}_i{t}"
        parts.append(f"{one}_t AS MATERIALIZED (SELECT *, {t} AS tree, 1 AS node, CAST(floor((y - p) * {TR.STEP}) AS BIGINT) AS yi FROM {name}_f{t})")
        parts += grow_sql(one, f"{one}_t", n, depth, n)
        parts.append(f"{name}_f{t + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (tree, node, yi, p), r.p + {rate}::DOUBLE * v.value AS p "
                     f"FROM {one}_w{depth - 1} r JOIN {one}_v v USING (tree, node))")
    return parts


def gains_sql(name: str, features: list[str], depth: int) -> str:
    names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(features))
    every = " UNION ALL ".join(f"SELECT feature, gain FROM {name}_s{level}" for level in range(depth))
    return (f"SELECT f.name AS feature, coalesce(sum(g.gain), 0) / (SELECT sum(gain) FROM ({every})) AS importance "
            f"FROM (VALUES {names}) AS f(i, name) LEFT JOIN ({every}) g ON g.feature = f.i GROUP BY 1")


def with_rows(*parts: str) -> str:
    return ROWS_SQL + ", train AS (SELECT * FROM rows WHERE yr < 2000)" + "".join(", " + p for p in parts)


# ---------------------------------------------------------------- queries
TREES, DEPTH = 100, 8


@query("m22_m28_forest_and_importances", ops=("M22", "M28"), sql=with_rows(*forest_sql("f", FEATS, TREES, DEPTH)) + f"""
SELECT feature, round(importance, 6) AS importance FROM ({gains_sql('f', FEATS, DEPTH)})""")
def m_forest(spark, sf_dir):
    train, _ = _split(_panel(spark, sf_dir))
    return TR.importances(TR.fit_forest(train, FEATS, LABEL, KEYS, TREES, DEPTH), spark).withColumn("importance", R("importance"))


@query("m34_batch_scoring_clip", ops=("M34", "S13", "O6", "S14"), sql=with_rows(
    *forest_sql("f", FEATS, TREES, DEPTH), "test AS (SELECT * FROM f_b WHERE yr >= 2000)",
    *forest_scores_sql("f", "p", FEATS, TREES, DEPTH, "test", "entity, yr, mo")) + """
SELECT entity, yr, mo, round(greatest(0, exp(p) - 1), 2) AS prediction FROM p""")
def m_score(spark, sf_dir):
    """A forest's node table written, read back, and joined to the rows of the test years."""
    train, test = _split(_panel(spark, sf_dir))
    path = scratch_path(spark, "forest")
    TR.save_nodes(TR.fit_forest(train, FEATS, LABEL, KEYS, TREES, DEPTH), spark, path)
    scored = TR.score_by_nodes(test, TR.load_nodes(spark, path), KEYS)
    return scored.select(*KEYS, R(F.greatest(F.expm1("prediction"), F.lit(0.0)), 2).alias("prediction"))


BOOST = {"iterations": 16, "depth": 3, "rate": 0.2}


@query("m23_gradient_boosting", ops=("M23", "M34", "V1"), sql=with_rows(*boosted_sql("g", FEATS, **BOOST)) + metrics_sql("") + f"""
FROM g_f{BOOST['iterations']} WHERE yr >= 2000""")
def m_gbt(spark, sf_dir):
    train, test = _split(_panel(spark, sf_dir))
    return _metrics(TR.score_by_nodes(test, TR.fit_boosted(train, FEATS, LABEL, KEYS, **BOOST), KEYS))


STOPPED = {"iterations": 40, "depth": 3, "rate": 0.3}
_ERRORS = " UNION ALL ".join(f"SELECT {t} AS t, sum(pow(y - p, 2)) AS e FROM g_f{t} WHERE yr = 1999" for t in range(1, STOPPED["iterations"] + 1))
_FITS = " UNION ALL ".join(f"SELECT {t} AS t, y, p FROM g_f{t} WHERE yr >= 2000" for t in range(1, STOPPED["iterations"] + 1))


@query("m24_gradient_boosting_early_stop", ops=("M24",), sql=with_rows(*boosted_sql("g", FEATS, **STOPPED, fitted_on="yr < 1999")) + f""",
errors AS MATERIALIZED ({_ERRORS}),
running AS (SELECT t, (SELECT e.t FROM errors e WHERE e.t <= errors.t ORDER BY e.e, e.t LIMIT 1) AS best FROM errors),
stopped AS (SELECT coalesce((SELECT arg_min(best, t) FROM running WHERE t - best >= 5), (SELECT arg_max(best, t) FROM running)) AS best),
p AS (SELECT y, p, t FROM ({_FITS}), stopped WHERE t = best)
{metrics_sql('p')}, CAST(any_value(t) AS BIGINT) AS n_trees FROM p""")
def m_gbt_es(spark, sf_dir):
    """Trees up to the lowest error on the last training year, once five more have not lowered it."""
    d = _panel(spark, sf_dir)
    _, test = _split(d)
    model = TR.fit_boosted(d, FEATS, LABEL, KEYS, **STOPPED, on=F.col("yr") < 1999, validate_on=F.col("yr") == 1999, patience=5)
    return _metrics(TR.score_by_nodes(test, model, KEYS)).withColumn("n_trees", F.lit(model.trees))


@query("m37_weighted_fit", ops=("M37", "E24"), sql=with_rows(*boosted_sql(
    "g", FEATS, 20, 3, 0.1, weight=f"CAST(round(1.0 / (n + 1) / (SELECT avg(1.0 / (n + 1)) FROM rows) * {TR.WEIGHT_STEP}) AS BIGINT)")) + metrics_sql("") + """
FROM g_f20 WHERE yr >= 2000""")
def m_weighted(spark, sf_dir):
    """Boosted trees on rows weighted by the inverse of their order count."""
    train, test = _split(E.inverse_weight(_panel(spark, sf_dir), "n"))
    model = TR.fit_boosted(train, FEATS, LABEL, KEYS, 20, 3, 0.1, weight="sample_weight")
    return _metrics(TR.score_by_nodes(test, model, KEYS))


WITHOUT = [c for c in FEATS if c != "n"]


def _ablation_sql(name: str, features: list[str]) -> list[str]:
    return [*forest_sql(name, features, 50, 6), f"{name}_test AS (SELECT * FROM {name}_b WHERE yr >= 2000)",
            *forest_scores_sql(name, f"{name}_p", features, 50, 6, f"{name}_test", "entity, yr, mo, y")]


@query("m35_feature_set_ablation", ops=("M35", "P20"), sql=with_rows(*_ablation_sql("a", FEATS), *_ablation_sql("w", WITHOUT)) + """
SELECT s AS feature_set, round(1 - sum(pow(y - p, 2)) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse
FROM (SELECT 'all' AS s, y, p FROM a_p UNION ALL SELECT 'without_n', y, p FROM w_p) GROUP BY 1""")
def m_ablation(spark, sf_dir):
    train, test = _split(_panel(spark, sf_dir))
    out = None
    for name, cols in (("all", FEATS), ("without_n", WITHOUT)):
        scored = TR.score_by_nodes(test, TR.fit_forest(train, cols, LABEL, KEYS, 50, 6), KEYS)
        one = V.metrics(scored, LABEL, "prediction", eps=None).select(F.lit(name).alias("feature_set"), R("r2").alias("r2"), R("rmse").alias("rmse"))
        out = one if out is None else out.unionByName(one)
    return out


FOLDED_SQL = "rowsf AS (SELECT *, (row_number() OVER (ORDER BY md5('42|' || entity || '|' || yr || '|' || mo), entity, yr, mo) - 1) % 3 AS fold FROM rows)"


def _oof_sql() -> list[str]:
    parts = [FOLDED_SQL]
    for k in range(3):
        parts += [f"train{k} AS (SELECT * FROM rowsf WHERE fold <> {k})", *forest_sql(f"o{k}", FEATS, 30, 6, f"train{k}", "rowsf"),
                  f"held{k} AS (SELECT * FROM o{k}_b WHERE fold = {k})",
                  *forest_scores_sql(f"o{k}", f"p{k}", FEATS, 30, 6, f"held{k}", "entity, yr, mo, y, fold")]
    return parts


@query("m38_out_of_fold_predictions", ops=("M38", "M10", "U1"), sql=ROWS_SQL + "".join(", " + p for p in _oof_sql()) + """
SELECT entity, yr, mo, CAST(fold AS BIGINT) AS fold, round(p, 6) AS prediction
FROM (FROM p0 UNION ALL FROM p1 UNION ALL FROM p2)""")
def m_oof(spark, sf_dir):
    """Every row predicted by the forest that did not see its fold."""
    d = cut_lineage(MP.kfold(_panel(spark, sf_dir), KEYS, k=3, seed=42))
    out = None
    for k in range(3):
        model = TR.fit_forest(d.where(F.col("fold") != k), FEATS, LABEL, KEYS, 30, 6)
        one = TR.score_by_nodes(d.where(F.col("fold") == k), model, KEYS).select(*KEYS, "fold", R("prediction").alias("prediction"))
        out = one if out is None else out.unionByName(one)
    return out


BAND_FEATS = [f"{b}_m{m}" for m in range(2, 9) for b in ("v", "n")]
_BANDS = ", ".join(f"max(CASE WHEN mo = {m} THEN {b} END) AS {b}_m{m}" for m in range(2, 9) for b in ("v", "n"))


@query("m31_band_selection_by_importance", ops=("M31", "F27", "E25"), sql="WITH " + Q.YEARLY + f""",
rows AS (SELECT w.*, ln(1 + total) AS y FROM (SELECT entity, yr, {_BANDS} FROM panel WHERE mo BETWEEN 2 AND 8 GROUP BY 1, 2 HAVING count(*) = 7) w
         JOIN (SELECT entity, yr, total FROM yearly) USING (entity, yr)), """ + ", ".join(
    forest_sql("f", BAND_FEATS, 50, 6, "rows", "rows", ["entity", "yr"])) + f""",
bands AS (SELECT split_part(feature, '_m', 1) AS band, sum(importance) AS importance FROM ({gains_sql('f', BAND_FEATS, 6)}) GROUP BY 1)
SELECT band FROM (SELECT band FROM bands ORDER BY importance DESC, band LIMIT 1) UNION SELECT 'n'""")
def m_bands(spark, sf_dir):
    from panelforge.operators import models as M
    p = P.base_panel(spark, sf_dir).where(F.col("mo").between(2, 8))
    seq = MP.sequences(p, P.PANEL, ["v", "n"], mode="strict").withColumn("flat", F.flatten("sequence"))
    wide = seq.select("entity", "yr", *[F.col("flat")[i].alias(nm) for i, nm in enumerate(BAND_FEATS)])
    tgt = P.yearly_panel(spark, sf_dir).select("entity", "yr", F.log1p("total").alias(LABEL))
    d = cut_lineage(wide.join(tgt, ["entity", "yr"]))
    model = TR.fit_forest(d, BAND_FEATS, LABEL, ["entity", "yr"], 50, 6)
    return M.band_importance(TR.importances(model, spark), 1, must_have=["n"])


def _permuted_sql() -> list[str]:
    """All variants of the test rows: per repeat and column, the partner's value in that column."""
    block = hash_sql(KEYS, 42) + " % 64"
    lend = ", ".join(f"CASE WHEN variant = '{c}' THEN d.{c} ELSE o.{c} END AS {c}" for c in FEATS)
    key = "o.entity AS entity, o.yr AS row_yr, o.mo AS row_mo"
    return ["test AS MATERIALIZED (SELECT * FROM rows WHERE yr >= 2000)",
            f"own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY entity, yr, mo) AS place FROM (SELECT *, {block} AS block FROM test))",
            """drawn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block, repeat ORDER BY md5(CAST(repeat + 43 AS VARCHAR) || '|' || entity || '|' || yr || '|' || mo), entity, yr, mo) AS at
              FROM own, range(10) AS r(repeat))""",
            f"""variants AS MATERIALIZED (SELECT {key}, o.y AS y, d.repeat AS repeat, variant, {lend}
              FROM own o JOIN drawn d ON d.block = o.block AND d.at = o.place, (SELECT unnest({FEATS!r}) AS variant)
              UNION ALL SELECT entity, yr, mo, y, -1, '', {', '.join(FEATS)} FROM test)"""]


@query("m30_permutation_importance", ops=("M30",), sql=with_rows(
    *forest_sql("f", FEATS, 20, 5), *_permuted_sql(), f"vb AS MATERIALIZED ({bins_of('f', 'variants', FEATS)})",
    *forest_scores_sql("f", "p", FEATS, 20, 5, "vb", "entity, row_yr, row_mo, y, repeat, variant")) + """,
r AS (SELECT variant, repeat, 1 - sum(pow(y - p, 2)) / (count(*) * var_pop(y)) AS r2 FROM p GROUP BY 1, 2)
SELECT variant AS feature, round(avg(b.r2 - r.r2), 6) + 0.0 AS mean_r2_drop, round(stddev_pop(b.r2 - r.r2), 6) AS std_r2_drop
FROM r, (SELECT r2 FROM r WHERE repeat = -1) b WHERE repeat >= 0 GROUP BY 1""")
def m_perm(spark, sf_dir):
    """Ten permutations of every column, scored together."""
    train, test = _split(_panel(spark, sf_dir))
    model = TR.fit_forest(train, FEATS, LABEL, KEYS, 20, 5)
    # the row's own year and month stay as its name, whatever the variant puts in their place
    rows = test.withColumns({"row_yr": F.col("yr"), "row_mo": F.col("mo")})
    keyed = rows.select("entity", F.col("yr").alias("k_yr"), F.col("mo").alias("k_mo"), LABEL, *FEATS)
    out = IM.permutation_importance(keyed, FEATS, LABEL, ["entity", "k_yr", "k_mo"],
                                    lambda d, keys: TR.score_by_nodes(d, model, keys), repeats=10, seed=42, blocks=64)
    return out.select("feature", (R("mean_r2_drop") + 0.0).alias("mean_r2_drop"), R("std_r2_drop").alias("std_r2_drop"))
