"""Scalar functions (F*), predicates (P*) and aggregates (A*) on literal
inputs with the reference's expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelforge.functions import predicates as PR
from panelforge.functions import scalar as S
from panelforge.operators import aggregates as A
from panelforge.operators import features as E


def test_number_text_and_codes(spark):
    d = spark.createDataFrame([("1,234",), ("(D)",), (" (D)",), ("NaN",), ("12.5",)], "v string")
    assert [r[0] for r in d.select(S.parse_number("v")).collect()] == [1234.0, None, None, None, 12.5]


def test_key_build_and_padding(spark):
    d = spark.createDataFrame([("27", "9.0"), ("27", None), ("27", "171")], "s string, c string")
    assert [r[0] for r in d.select(S.build_key("s", "c")).collect()] == [27009, 27000, 27171]
    d2 = spark.createDataFrame([(7,), (12345,)], "x int")
    assert [r[0] for r in d2.select(S.zero_pad("x", 3)).collect()] == ["007", "12345"]  # never truncates


def test_distance_bins_right_closed(spark):
    d = spark.createDataFrame([(0.0,), (25.0,), (25.1,), (50.0,), (200.0,)], "x double")
    assert [r[0] for r in d.select(E.cut("x")).collect()] == [None, "Very Close", "Close", "Close", "Far"]


def test_squeeze_contains_and_dates(spark):
    d = spark.createDataFrame([(" Lac qui-Parle ", "2001-03"), (None, "3/4/1995"), ("x", "bad")], "n string, d string")
    r = d.select(S.squeeze("n").alias("sq"), S.contains_ci("n", "QUI").alias("c"),
                 S.year_part(S.parse_date("d")).alias("y"), S.month_part(S.parse_date("d")).alias("m")).collect()
    assert [x["sq"] for x in r] == ["LACQUIPARLE", None, "X"]
    assert [x["c"] for x in r] == [True, False, False]
    assert [(x["y"], x["m"]) for x in r] == [(2001, 3), (1995, 3), (None, None)]


def test_row_mean_ratio_and_fence(spark):
    d = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in d.select(S.row_mean(["a", "b", "c"])).collect()] == [2.0, None]
    t = spark.createDataFrame([('```json\n{"k": 3}\n```',), ('{"k": 4}',), ("nope",)], "t string")
    assert [r[0] for r in t.select(S.parse_json_fields("t", "k int")["k"]).collect()] == [3, 4, None]


def test_inf_null_fill_clip(spark):
    d = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in PR.inf_to_null(d).collect()] == [None, None, None, 2.0]
    assert [r[0] for r in PR.fill_zero(d).collect()] == [0.0, 0.0, 0.0, 2.0]
    assert [r[0] for r in d.select(PR.clip("x", -1, 1)).collect()][-1] == 1.0


def test_quantile_and_skew_kurtosis(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    q = {r["q"]: r["value"] for r in A.quantiles(d, "x", [0.25, 0.5]).collect()}
    assert q[0.25] == pytest.approx(1.75) and q[0.5] == pytest.approx(3.0)
    c = A.skew_kurt(d, ["x"], bias=False).first()
    assert c["skewness"] == pytest.approx(1.33094, abs=1e-5) and c["kurtosis"] == pytest.approx(1.5, abs=1e-9)
    b = A.skew_kurt(d, ["x"], bias=True).first()
    assert b["skewness"] == pytest.approx(0.76842, abs=1e-5) and b["kurtosis"] == pytest.approx(-1.0, abs=1e-9)


def test_histogram_last_bin_closed_and_empty_bins(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in A.histogram(d, "x", 5).collect()}
    assert h == {1: 3, 2: 0, 3: 0, 4: 0, 5: 1}


def test_describe_box_mode_first_by(spark):
    d = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 2), (1, 2.0, 3), (2, 100.0, 1)], "g int, x double, t int")
    desc = {r["statistic"]: r["value"] for r in A.describe_numeric(d, ["x"]).collect()}
    assert desc["count"] == 4 and desc["50%"] == pytest.approx(2.0)
    assert A.mode(d, "x").first()["mode"] == 2.0
    fb = {r["g"]: r["x"] for r in A.first_by(d, ["g"], ["x"], "t").collect()}
    assert fb == {1: 1.0, 2: 100.0}
    box = A.box_stats(d, "x").first()
    assert box["n_outliers"] == 1 and box["whisker_hi"] == 2.0


def test_value_counts_and_annualize(spark):
    d = spark.createDataFrame([("a", 1, 7.0), ("a", 2, 7.0), ("b", 1, 3.0)], "k string, m int, y double")
    vc = {r["k"]: r["share"] for r in A.value_counts(d, "k", normalize=True).collect()}
    assert vc["a"] == pytest.approx(2 / 3)
    s = {r["k"]: r["y"] for r in A.annualize(d, ["k"], ["y"], "sum").collect()}
    m = {r["k"]: r["y"] for r in A.annualize(d, ["k"], ["y"], "mean").collect()}
    assert s["a"] == 14.0 and m["a"] == 7.0


def test_kde_integrates_to_one(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(float(x),) for x in rng.normal(size=300)], "x double")
    k = sorted((r["x"], r["density"]) for r in A.kde(d, "x", 200).collect())
    xs, ys = np.array([a for a, _ in k]), np.array([b for _, b in k])
    assert np.trapezoid(ys, xs) == pytest.approx(1.0, abs=0.08)


def test_corr_pairwise_complete(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.0)], "a double, b double")
    cm = {(r["a"], r["b"]): r["corr"] for r in A.corr_matrix(d, ["a", "b"]).collect()}
    assert cm[("a", "b")] == pytest.approx(cm[("b", "a")]) and cm[("a", "b")] > 0.99
    assert F is not None


def test_exact_quantile_methods_agree(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    vals = [(float(x), float(int(x * 3) % 4)) for x in rng.normal(size=500)]
    d = spark.createDataFrame(vals, "hi double, lo double")
    qs = [0.1, 0.25, 0.5, 0.9]
    auto = A.quantiles_by_column(d, ["hi", "lo"], qs)
    for c in ("hi", "lo"):
        exp = np.quantile(np.array([v[0] if c == "hi" else v[1] for v in vals]), qs)
        assert auto[c] == pytest.approx(list(exp), abs=1e-12)
        assert A.exact_quantiles(d, c, qs) == pytest.approx(list(exp), abs=1e-12)
        assert A.exact_quantiles(d, c, qs, "percentile") == pytest.approx(list(exp), abs=1e-12)


def test_grouped_quantiles_skewed_group(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    # group 0 holds most of the rows and many distinct values
    rows = [(0, float(x)) for x in rng.normal(size=3000)] + [(g, float(x)) for g in range(1, 6)
                                                             for x in rng.normal(g, 1, size=40)]
    d = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: (r["q25"], r["q50"], r["q90"]) for r in
           A.grouped_quantiles(d, ["g"], "x", [0.25, 0.5, 0.9]).collect()}
    for g in range(6):
        xs = np.array([x for gg, x in rows if gg == g])
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0.25, 0.5, 0.9])), abs=1e-12)
    pm = {r["g"]: r["x"] for r in A.median_by(d, ["g"], ["x"]).collect()}
    sm = {r["g"]: r["x"] for r in A.median_by(d, ["g"], ["x"], method="percentile").collect()}
    assert pm == pytest.approx(sm, abs=1e-12)


def test_exact_quantiles_extremes(spark):
    import numpy as np
    xs = [1e308, -1e308, 5e-324, 0.0, 1.0, 1.0, 1.0 + 2 ** -52, float("nan"), None, 7.0]
    d = spark.createDataFrame([(x, None) for x in xs], "x double, none double")
    kept = np.array([x for x in xs if x is not None and x == x])
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = A.quantiles_by_column(d, ["x", "none"], qs)
    order = np.sort(kept)
    assert got["none"] == [None] * 5
    assert got["x"][0] == order[0] and got["x"][4] == order[-1] and got["x"][2] == np.quantile(kept, 0.5)
