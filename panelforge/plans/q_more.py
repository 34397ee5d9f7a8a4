"""Queries that run operators in the form the survey states them: three-key
and zero-filled joins, pattern means, forecast years, predictions attached by
key, pair samples, flattened sequences, the full band range table, and the
file sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import scalar as S
from panelforge.operators import features as E
from panelforge.operators import grid as Z
from panelforge.operators import joins as J
from panelforge.operators import mlprep as MP
from panelforge.operators import quality as QL
from panelforge.operators import windows as W
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query
from panelforge.session import scratch_path
from panelforge.sources import files as SF


def R(c, n=4):
    return F.round(c, n)


@query("j02_j06_three_key_join_default_zero", ops=("J2", "J6"), sql=Q.with_(Q.SPARSE) + """
, src AS (SELECT entity, yr, mo, item FROM pitem WHERE item IS NOT NULL)
SELECT p.entity, p.yr, p.mo, round(p.v, 4) AS v, round(coalesce(s.item, 0.0), 4) AS item,
       CAST(s.item IS NULL AS BIGINT) AS is_imputed_zero
FROM panel p LEFT JOIN src s ON p.entity = s.entity AND p.yr = s.yr AND p.mo = s.mo""")
def j_three_keys(spark, sf_dir):
    src = P.panel_with_item(spark, sf_dir).where("item IS NOT NULL").select("entity", "yr", "mo", "item")
    d = J.left_enrich(P.base_panel(spark, sf_dir), src, ["entity", "yr", "mo"], fill=0.0, flag="is_imputed_zero")
    return d.select("entity", "yr", "mo", R("v").alias("v"), R("item").alias("item"), "is_imputed_zero")


@query("e06_temperature_average", ops=("E6",), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, mo, round(CASE WHEN mo = 1 THEN (v + n) / 2 ELSE (v + n + v + 2 * n) / 3 END, 4) AS temperature_avg FROM panel""")
def e_temperature(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    d = p.select("entity", "yr", "mo", F.col("v").alias("Tair_f_inst"), F.col("n").cast("double").alias("TMIN (degrees F)"),
                 F.when(F.col("mo") > 1, F.col("v") + 2 * F.col("n")).alias("tmax (degrees F)"), F.col("total").alias("rain"))
    d = E.pattern_mean(d, E.TEMPERATURE_PATTERNS, "temperature_avg", E.TEMPERATURE_PATTERNS_CI)
    return d.select("entity", "yr", "mo", R("temperature_avg").alias("temperature_avg"))


@query("w18_forecast_year", ops=("W18",), sql=Q.with_(Q.PANEL) + """
SELECT entity, max(yr) AS latest_year, max(yr) + 1 AS forecast_year FROM panel GROUP BY entity""")
def w_forecast(spark, sf_dir):
    return W.forecast_year(P.base_panel(spark, sf_dir), "entity", "yr")


@query("j12_attach_predictions", ops=("J12",), sql=Q.with_(Q.YEARLY) + """
, preds AS (SELECT entity, yr + 1 AS yr, n AS pred FROM yearly)
SELECT y.entity, y.yr, y.n, p.pred FROM yearly y LEFT JOIN preds p USING (entity, yr)""")
def j_attach(spark, sf_dir):
    y = P.yearly_panel(spark, sf_dir).select("entity", "yr", "n")
    preds = y.select("entity", (F.col("yr") + 1).alias("yr"), F.col("n").alias("pred"))
    return J.attach_predictions(y, preds, ["entity", "yr"])


@query("q12_pair_sample", ops=("Q12",), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, mo, n, round(total, 2) AS total FROM panel
ORDER BY md5('42|' || entity || '|' || yr || '|' || mo), entity, yr, mo LIMIT 300""")
def q_pairs(spark, sf_dir):
    d = QL.pair_sample(P.base_panel(spark, sf_dir), ["entity", "yr", "mo"], ["n", "total"], n=300, seed=42)
    return d.withColumn("total", R("total", 2))


@query("f31_flatten_sequences", ops=("F31", "M17"), sql=Q.with_(Q.PANEL) + """
, s AS (SELECT *, count(*) OVER (PARTITION BY entity, yr) AS steps FROM panel WHERE mo BETWEEN 2 AND 8)
SELECT entity, yr, 2 * (mo - 2) AS k, CAST(n AS DOUBLE) AS x FROM s WHERE steps = 7
UNION ALL SELECT entity, yr, 2 * (mo - 2) + 1 AS k, CAST(mo AS DOUBLE) AS x FROM s WHERE steps = 7""")
def f_flatten(spark, sf_dir):
    seq = MP.sequences(P.base_panel(spark, sf_dir), P.PANEL, ["n", "mo"], mode="strict")
    return seq.select("entity", "yr", F.posexplode(S.flatten_sequence("sequence")).alias("k", "x"))


BANDS = list(Z.BAND_RANGES)


def _band(i: int) -> str:
    """Band ``i`` of the fixture: whole numbers of a spread that leaves some out of range."""
    return f"CAST((n * {i + 3} + mo * {7 * i + 1}) * {10 ** (i % 5)} - {100 * (i % 3)} AS DOUBLE)"


def _range_sql(i: int, band: str) -> str:
    lo, hi = (float(x) for x in Z.BAND_RANGES[band])
    return (f"SELECT '{band}' AS band, {lo!r}::DOUBLE AS expected_min, {hi!r}::DOUBLE AS expected_max, min({_band(i)}) AS \"min\", "
            f"max({_band(i)}) AS \"max\", CAST(count_if({_band(i)} < {lo!r}::DOUBLE OR {_band(i)} > {hi!r}::DOUBLE) AS BIGINT) "
            f"AS n_out_of_range, CAST(36 AS BIGINT) AS n_bands FROM panel")


@query("z05_q07_all_band_ranges", ops=("Z5", "Q7"),
       sql=Q.with_(Q.PANEL) + "\nUNION ALL\n".join(_range_sql(i, b) for i, b in enumerate(BANDS)))
def z_all_bands(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    d = p.select("entity", "yr", "mo", *[F.expr(_band(i)).alias(b) for i, b in enumerate(BANDS)])
    present = [c for c in d.columns if c in Z.BAND_RANGES]
    QL.expect(d, {"band_count": F.lit(len(present)) == 36})
    return Z.range_check(d, Z.BAND_RANGES).withColumn("n_bands", F.lit(len(present)))


@query("s05_json_record_files", ops=("S5",), sql="""
SELECT c_custkey, c_nationkey AS county_code, c_name AS county_name, round(c_acctbal, 2) AS value FROM customer""")
def s_json_files(spark, sf_dir):
    c = P.table(spark, sf_dir, "customer")
    record = F.struct("c_custkey", F.col("c_nationkey").alias("county_code"), F.col("c_name").alias("county_name"),
                      F.col("c_acctbal").alias("Value"))
    docs = c.groupBy(F.expr("c_custkey div 100").alias("page")).agg(F.collect_list(record).alias("data"))
    path = scratch_path(spark, "records")
    docs.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("county_code", T.IntegerType()),
                           T.StructField("county_name", T.StringType()), T.StructField("Value", T.DoubleType())])
    d = SF.read_json_records(spark, path, "data", schema, lines=True)
    return d.select("c_custkey", "county_code", "county_name", R("Value", 2).alias("value"))


@query("s06_s10_wide_predictions_and_dimension", ops=("S6", "S10", "J4"), sql=Q.with_(Q.YEARLY) + """
SELECT y.entity, n.n_name AS county_name, y.yr, y.n AS actual, CAST(y.n + 1 AS DOUBLE) AS model_a,
       CASE WHEN y.yr = 1997 THEN NULL ELSE CAST(y.n * 2 AS DOUBLE) END AS model_b
FROM yearly y JOIN nation n ON n.n_nationkey = y.entity""")
def s_wide(spark, sf_dir):
    y = P.yearly_panel(spark, sf_dir)
    wide = y.select("entity", "yr", F.col("n").alias("actual"), (F.col("n") + 1).cast("double").alias("model_a"),
                    F.when(F.col("yr") == 1997, F.lit(float("nan"))).otherwise(F.col("n") * 2.0).alias("model_b"))
    preds, names = scratch_path(spark, "wide"), scratch_path(spark, "dimension")
    SF.write_table(wide, preds, fmt="csv")
    SF.write_table(P.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), names, fmt="csv")
    d = SF.read_table(spark, preds, "entity INT, yr INT, actual BIGINT, model_a DOUBLE, model_b DOUBLE", fmt="csv")
    dim = SF.read_table(spark, names, "entity INT, county_name STRING", fmt="csv")
    return J.left_enrich(d, dim, ["entity"]).select("entity", "county_name", "yr", "actual", "model_a", "model_b")
