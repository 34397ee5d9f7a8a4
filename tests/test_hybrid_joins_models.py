"""Hybrid rules (H*), joins (J*), kNN and ML preparation (M*)."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import hybrid as H
from panelforge.operators import joins as J
from panelforge.operators import mlprep as MP
from panelforge.operators import models as M


def test_adjust_only_and_bands(spark):
    d = spark.createDataFrame([(100.0, 0.5, 80.0, 120.0)], "y double, a double, p10 double, p90 double")
    r = d.select(H.adjust("y", "a").alias("y"), H.adjust_bands("p10", "a").alias("lo"),
                 H.adjust_bands("p90", "a").alias("hi")).first()
    assert (r["y"], r["lo"], r["hi"]) == pytest.approx((120.0, 91.2, 136.8))


def test_damped_rule(spark):
    d = spark.createDataFrame([(100.0, -0.3, 20.0, 10.0)], "y double, raw double, band double, rmse double")
    r = H.damped_adjust(d, "y", "raw", "band", "rmse").first()
    assert r["adj"] == pytest.approx(-0.1297, abs=1e-4) and r["pred_adjusted"] == pytest.approx(87.03, abs=0.01)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-5, 5), st.floats(0.01, 1e6))
def test_adjust_stays_in_bounds(spark, a, y):
    d = spark.createDataFrame([(y, a)], "y double, a double")
    v = d.select(H.adjust("y", "a")).first()[0]
    assert y * 0.8 - 1e-6 <= v <= y * 1.2 + 1e-6


def test_stack_weights_on_simplex(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(100, 10, 300)
    rows = [(float(t), float(t + rng.normal(0, 1)), float(t + rng.normal(0, 5)), float(rng.normal(100, 10))) for t in y]
    d = spark.createDataFrame(rows, "y double, a double, b double, c double")
    w = H.fit_stack(d, ["a", "b", "c"], "y", lam=0.001)
    assert sum(w.values()) == pytest.approx(1.0) and min(w.values()) >= 0
    assert w["a"] > w["b"] > w["c"]


def test_parse_adjustments_fallbacks(spark):
    d = spark.createDataFrame([("```json\n{\"adjustment\": 0.5, \"drivers\": [\"a\",\"b\",\"c\"]}\n```",),
                               ("{\"drivers\": []}",), ("garbage",), (None,)], "t string")
    r = H.parse_adjustments(d, "t").collect()
    assert [x["parsed"] for x in r] == [True, True, False, False]
    assert [x["adjustment"] for x in r] == [0.2, 0.0, 0.0, 0.0]


def test_match_names_tiers(spark):
    dim = spark.createDataFrame([(1, "Lac qui Parle"), (2, "Saint Louis"), (3, "Louise")], "k int, name string")
    left = spark.createDataFrame([("LAC QUI PARLE",), ("LacquiParle",), ("Louis",), ("nowhere",)], "n string")
    m = {r["n"]: (r["match_key"], r["match_key_tier"]) for r in J.match_names(left, "n", dim, "name", "k").collect()}
    assert m["LAC QUI PARLE"] == (1, 1) and m["LacquiParle"] == (1, 2)
    assert m["Louis"] == (2, 3)  # both "SAINTLOUIS" and "LOUISE" contain it: smallest key wins
    assert m["nowhere"] == (None, None)


def test_latest_per_key_and_calendar(spark):
    d = spark.createDataFrame([(1, 2000, "a"), (1, 2002, "b"), (2, 1999, "c")], "k int, y int, v string")
    assert {r["k"]: r["v"] for r in J.latest_per_key(d, "k", ["y"]).collect()} == {1: "b", 2: "c"}
    cal = J.calendar(spark, 2000, 2001, [2, 3])
    assert cal.count() == 4
    assert "CartesianProduct" not in cal._jdf.queryExecution().executedPlan().toString()


def test_left_enrich_leaves_the_choice_to_the_planner(spark):
    small = spark.range(10).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    out = J.left_enrich(spark.range(1000).withColumnRenamed("id", "k"), small, ["k"], fill=0)
    assert out.where("v = 1").count() == 10 and out.where("v = 0").count() == 990


def test_match_names_long_and_short(spark):
    long = "a very long county name " * 20
    dim = spark.createDataFrame([(1, long + "north"), (2, "xq"), (3, "SAINT PAUL")], "k int, n string")
    left = spark.createDataFrame([(long + "nor",), ("q",), ("paul",), ("",), (None,)], "name string")
    got = {r["name"]: (r["match_key"], r["match_key_tier"]) for r in J.match_names(left, "name", dim, "n", "k").collect()}
    assert got == {long + "nor": (1, 3), "q": (2, 3), "paul": (3, 3), "": (None, None), None: (None, None)}


def test_scalers_fit_on_train_only(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 100.0)], "split int, x double")
    st_ = MP.fit_robust(d, ["x"], fit_on=F.col("split") == 1)
    assert st_.center["x"] == 2.0 and st_.scale["x"] == 1.0
    out = MP.inverse(MP.transform(d, st_), st_)
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 3.0, 100.0]


def test_folds_disjoint_and_complete(spark):
    d = spark.range(500).withColumnRenamed("id", "k")
    f = MP.kfold(d, ["k"], k=5)
    assert f.count() == 500 and f.select("fold").distinct().count() == 5


def test_pca_centres_and_fixes_sign(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.1]]) + 50
    d = spark.createDataFrame([tuple(map(float, x)) for x in X], "a double, b double, c double")
    res = M.pca(d, ["a", "b", "c"], k=2)
    s = res.scores(d)
    m = s.agg(F.avg("pc1"), F.avg("pc2")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9
    assert all(res.loadings[np.abs(res.loadings[:, j]).argmax(), j] > 0 for j in range(2))
    assert res.explained[0] > res.explained[1]


@pytest.mark.parametrize("partitions", [4, 8, 200])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_global_row_index_is_exact(spark, partitions, reuse):
    from panelforge.operators import windows as W
    rng = np.random.default_rng(3)
    rows = [(i, float(x), f"pad{i}") for i, x in enumerate(rng.integers(0, 4000, 9000))]
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        d = spark.createDataFrame(rows, "k int, price double, pad string").repartition(7)
        got = {r["k"]: r["i"] for r in W.global_row_index(d, ["price", "k"], partitions=partitions, out="i").collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    want = {k: i for i, (_, k) in enumerate(sorted((p, k) for k, p, _ in rows), 1)}
    assert got == want


def test_slugs_never_clash():
    from panelforge.functions import scalar as S
    name = "SALES, MEASURED IN $ / OPERATION OF ALL KINDS AND SIZES, WITH "
    out = S.slugs([name + "ONE", name + "TWO", "A-B", "A B"])
    assert len(set(out.values())) == 4 and max(map(len, out.values())) <= 50
    assert S.slug("Corn, Grain - Acres/Op") == "corn_grain_acres_op"
