"""Gap filling (W1-W9): literal cases, pandas equivalence, plan shape."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelforge.operators import windows as W
from panelforge.spec import PanelSpec

SPEC = PanelSpec(entity="e", year="y", month="m")
SCHEMA = "e int, y int, m int, x double"


def _df(spark, vals, e=1, y0=2000, months_per_year=12):
    recs = []
    for i, v in enumerate(vals):
        recs.append((e, y0 + i // months_per_year, 1 + i % months_per_year, v))
    return spark.createDataFrame(recs, SCHEMA)


def _col(df):
    return [r["x"] for r in df.orderBy("e", "y", "m").collect()]


def test_ffill_bfill_interpolate_literals(spark):
    d = _df(spark, [None, 1.0, None, 4.0, None])
    assert _col(W.ffill(d, ["x"], SPEC)) == [None, 1.0, 1.0, 4.0, 4.0]
    assert _col(W.bfill(d, ["x"], SPEC)) == [1.0, 1.0, 4.0, 4.0, None]
    assert _col(W.interpolate(d, ["x"], SPEC)) == [1.0, 1.0, 2.5, 4.0, 4.0]


def test_fill_carries_across_year_chunks(spark):
    # 2 values per year -> every fill must cross the (entity, year) chunks
    d = _df(spark, [None, None, 3.0, None, None, None, None, 9.0, None, None], months_per_year=2)
    assert _col(W.ffill(d, ["x"], SPEC)) == [None, None, 3, 3, 3, 3, 3, 9, 9, 9]
    assert _col(W.bfill(d, ["x"], SPEC)) == [3, 3, 3, 9, 9, 9, 9, 9, None, None]
    got = _col(W.interpolate(d, ["x"], SPEC))
    assert got[:3] == [3, 3, 3] and got[-3:] == [9, 9, 9]
    assert got[3:8] == pytest.approx([4.2, 5.4, 6.6, 7.8, 9.0])


def test_entities_do_not_leak(spark):
    a = _df(spark, [1.0, None, None], e=1)
    b = _df(spark, [None, None, 5.0], e=2)
    d = a.unionByName(b)
    out = {(r["e"], r["m"]): r["x"] for r in W.ffill(d, ["x"], SPEC).collect()}
    assert out[(2, 1)] is None and out[(1, 3)] == 1.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=30),
       st.integers(1, 5))
def test_matches_pandas(spark, vals, per_year):
    d = _df(spark, vals, months_per_year=per_year)
    s = pd.Series([np.nan if v is None else v for v in vals], dtype=float)
    exp_f, exp_b = s.ffill().tolist(), s.bfill().tolist()
    exp_i = s.interpolate(method="linear", limit_direction="both").tolist()
    for got, exp in ((_col(W.ffill(d, ["x"], SPEC)), exp_f), (_col(W.bfill(d, ["x"], SPEC)), exp_b),
                     (_col(W.interpolate(d, ["x"], SPEC)), exp_i)):
        for g, e in zip(got, exp):
            if isinstance(e, float) and math.isnan(e):
                assert g is None
            else:
                assert g == pytest.approx(e, abs=1e-9)


def test_cascade_stage_counters_and_no_nulls(spark):
    recs = []
    for e in range(3):
        for y in range(2000, 2004):
            for m in (1, 2):
                v = float(e * 10 + y - 2000) if (e < 2 and (y + m) % 3 == 0) else None
                recs.append((e, y, m, v))
    d = spark.createDataFrame(recs, SCHEMA)
    out, log = W.impute_cascade(d, ["x"], SPEC)
    assert out.where("x IS NULL").count() == 0
    steps = {r["stage"]: (r["missing"], r["filled"]) for r in log.collect()}
    assert steps["median"][0] == 0
    assert steps["year_median"][1] == 8  # entity 2 has no data at all: filled by year medians
    ref_out, ref_log = W.impute_cascade(d, ["x"], SPEC, stages="reference")
    ref = {r["stage"]: r["filled"] for r in ref_log.collect()}
    assert ref["interpolate"] == 0 and ref["entity_median"] == 0  # the reference's dead stages


def test_global_fill_crosses_entities(spark):
    a = _df(spark, [1.0, None], e=1)
    b = _df(spark, [None, 7.0], e=2)
    out = {(r["e"], r["m"]): r["x"] for r in W.ffill_global(a.unionByName(b), ["x"], SPEC).collect()}
    assert out[(1, 2)] == 1.0 and out[(2, 1)] == 1.0 and out[(2, 2)] == 7.0


def test_pct_change_and_recent(spark):
    d = spark.createDataFrame([(1, 2000, 10.0), (1, 2001, 15.0), (1, 2002, 0.0), (1, 2003, 5.0)], "e int, y int, x double")
    spec = PanelSpec(entity="e", year="y", month=None)
    pc = [r["p"] for r in W.pct_change(d, "x", spec, out="p").orderBy("y").collect()]
    assert pc == [None, 0.5, -1.0, None]  # division by zero -> NULL
    rm = W.recent_mean(d, "e", "y", "x", 3).first()
    assert rm["recent_mean"] == pytest.approx(20.0 / 3)


def test_window_plan_is_not_single_partition_on_rows(spark):
    d = _df(spark, [None, 1.0, None, 4.0, None] * 10)
    plan = W.ffill(d, ["x"], SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(e" in plan
    assert "SinglePartition" not in plan


def test_qq_and_ppf(spark):
    from pyspark.sql import functions as F
    d = spark.createDataFrame([(0.0001,), (0.5,), (0.975,)], "p double")
    got = [r[0] for r in d.select(W.norm_ppf(F.col("p"))).collect()]
    assert got == pytest.approx([-3.719016, 0.0, 1.959964], abs=1e-5)


def test_scan_global_matches_sequential(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, (float(rnd.randint(0, 9)) if rnd.random() < 0.3 else None)) for i in range(400)]
    d = spark.createDataFrame(rows, "o int, x double")
    out = {r["o"]: (r["__prev_x"], r["__next_x"]) for r in W.scan_global(d, ["o"], ["x"], ["x"], partitions=8).collect()}
    last = None
    for o, x in rows:
        assert out[o][0] == last
        if x is not None:
            last = x
    nxt = None
    for o, x in reversed(rows):
        assert out[o][1] == nxt
        if x is not None:
            nxt = x
    ranks = {r["k"]: r["rank"] for r in W.rank_entities(spark.createDataFrame(
        [(i, float(i % 7)) for i in range(50)], "k int, t double"), "t", "k").collect()}
    assert ranks[6] == 1 and ranks[13] == 2 and len(set(ranks.values())) == 50
