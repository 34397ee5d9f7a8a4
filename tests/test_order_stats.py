"""Order statistics: infinities, subnormals, many decades, ties, hot groups, and a bound on the passes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import order_stats as OS
from panelforge.operators import windows as W

INF = float("inf")


def _expected(xs, q):
    xs = sorted(xs)
    h = (len(xs) - 1) * q
    a, b = xs[int(h)], xs[min(int(h) + 1, len(xs) - 1)]
    return OS.between(a, b, h - int(h))


def _frame(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double")


@pytest.mark.parametrize("xs", [[1.0, 2.0, 3.0, INF], [-INF, 1.0, 2.0, 3.0], [INF, INF, -INF], [5e-324, 0.0, -5e-324, 1e308, -1e308],
                                [7.0] * 9, [0.0, -0.0, 0.0], [1.0, 1.0 + 2**-52, 1.0 + 2**-51]])
def test_strained_columns(spark, xs):
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = OS.quantiles_by_column(_frame(spark, xs), ["x"], qs)["x"]
    want = [_expected(xs, q) for q in qs]
    assert all(g == w or math.isnan(g) and math.isnan(w) for g, w in zip(got, want))


def test_passes_are_bounded(spark, monkeypatch):
    passes = []
    inner = OS._cut_spans
    monkeypatch.setattr(OS, "_cut_spans", lambda *a: passes.append(1) or inner(*a))
    monkeypatch.setattr(OS, "FEW_ROWS", 1)
    rng = np.random.default_rng(1)
    decades = [float(x) for x in 10.0 ** rng.uniform(-300, 300, 400)]
    close = [1.0 + k * 2**-52 for k in range(300)] + [1.9999]
    for xs in (decades, close, [*decades, INF, -INF]):
        passes.clear()
        got = OS.quantiles_by_column(_frame(spark, xs), ["x"], [0.1, 0.5, 0.9])["x"]
        assert got == pytest.approx([_expected(xs, q) for q in (0.1, 0.5, 0.9)], rel=1e-15)
        assert len(passes) <= 6


def test_log_codes_never_fall(spark):
    rng = np.random.default_rng(2)
    xs = sorted({*(float(s * m * 2.0**e) for s in (-1, 1) for e in range(-1070, 1020, 37) for m in (1, 1 + 2**-52, 1.5, 2 - 2**-52)),
                 *map(float, rng.normal(size=500)), 0.0, INF, -INF, 5e-324})
    codes = [r[0] for r in _frame(spark, xs).coalesce(1).select(OS.log_code(OS.F.col("x"))).collect()]
    assert codes == sorted(codes)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(
    st.none(), st.floats(allow_nan=True), st.sampled_from([INF, -INF, 0.0, 1.5]))), min_size=1, max_size=40))
def test_grouped_medians_match_sorting(spark, rows):
    d = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["x"] for r in A.median_by(d, ["g"], ["x"]).collect()}
    assert set(got) == {g for g, _ in rows}
    for g in got:
        xs = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        want = _expected(xs, 0.5) if xs else None
        assert got[g] == want or (want is not None and math.isnan(want) and math.isnan(got[g]))


def test_hot_group_narrows_without_value_maps(spark, monkeypatch):
    monkeypatch.setattr(OS, "FEW_ROWS", 50)
    monkeypatch.setattr(OS, "BINS", 16)
    rng = np.random.default_rng(3)
    rows = [(0, float(x), float(int(abs(x) * 3))) for x in rng.normal(size=4000)]
    rows += [(g, float(x), 1.0) for g in range(1, 30) for x in rng.normal(g, 1, size=int(rng.integers(1, 60)))]
    d = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r["g"]: r for r in OS.grouped_quantiles(d, ["g"], ["x", "y"], [0.25, 0.9]).collect()}
    assert len(got) == 30
    for g, r in got.items():
        for c, i in (("x", 1), ("y", 2)):
            xs = [row[i] for row in rows if row[0] == g]
            assert (r[f"{c}_q25"], r[f"{c}_q90"]) == pytest.approx(tuple(np.quantile(xs, [0.25, 0.9])), abs=1e-12)
    medians = A.median_by(d, ["g"], ["x"])
    assert "percentile" not in medians._jdf.queryExecution().toString()


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "g int, x double")
    assert OS.quantiles_by_column(none, ["x"], [0.5]) == {"x": [None]}
    assert A.median_by(none, ["g"], ["x"]).count() == 0
    assert A.median_by(none, [], ["x"]).collect()[0]["x"] is None
    assert OS.value_ranks(none, "x", ["g"]).count() == 0
    assert W.qq_table(none, "x").count() == 0


def test_ranks_count_ties_once(spark):
    xs = [1.0] * 500 + [2.0] * 3 + [5.0] + [None]
    d = spark.createDataFrame([(i % 2, x) for i, x in enumerate(xs)], "g int, x double")
    ranks = OS.value_ranks(d, "x", partitions=3)
    assert sorted((r["x"], r["n"], r["before"]) for r in ranks.collect()) == [(1.0, 500, 0), (2.0, 3, 500), (5.0, 1, 503)]
    every = OS.expand_ranks(ranks, "i", rows_per_piece=64).collect()
    assert [r["x"] for r in sorted(every, key=lambda r: r["i"])] == [x for x in xs if x is not None]
    assert sorted(r["i"] for r in every) == list(range(1, 505))
    by = {(r["g"], r["x"]): (r["n"], r["before"]) for r in OS.value_ranks(d, "x", ["g"], partitions=5).collect()}
    assert by[0, 1.0] == (250, 0) and by[1, 1.0] == (250, 0) and by[0, 2.0] == (2, 250) and by[1, 5.0] == (1, 251)


def test_quantiles_of_values_that_differ_between_evaluations(spark):
    """A sum of doubles comes out otherwise in its last bits each time; all passes and the labels see one evaluation."""
    import random

    from panelforge.operators import features as E

    @F.udf("double")
    def summed(x):
        return x * (1 + random.random() * 1e-9)

    d = spark.range(9000).select((F.col("id") * 7919 % 9001 + 1000000.0).alias("x")).select(summed("x").alias("x"))
    got = OS.quantiles_by_column(d, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    xs = [i * 7919 % 9001 + 1000000.0 for i in range(9000)]
    assert got == pytest.approx(list(np.quantile(xs, [0.0, 0.25, 0.5, 0.75, 1.0])), abs=0.01)
    one = E.target_quartile(d, "x", out="q").collect()
    edges = np.quantile([r["x"] for r in one], [0.25, 0.5, 0.75])
    assert [r["q"] for r in one] == [int(np.searchsorted(edges, r["x"])) for r in one]


def test_ranks_are_expanded_in_several_tasks(spark):
    """Pieces are so small that Spark put those of any number of rows into one task."""
    d = spark.range(120_000).select((F.col("id") % 3).cast("double").alias("x"))
    every = OS.expand_ranks(OS.value_ranks(d, "x"), "i", rows_per_piece=1000, rows_per_task=10_000)
    tasks = [r["count"] for r in every.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 120_000 and len(tasks) >= 8 and max(tasks) <= 40_000
    assert every.agg(F.count_distinct("i"), F.min("i"), F.max("i")).first() == (120_000, 1, 120_000)
