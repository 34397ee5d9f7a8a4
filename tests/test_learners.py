"""Additive linear fits, node-table trees, one-pass permutation importance, resumable searches and stacking weights."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import hybrid as H
from panelforge.operators import importance as IM
from panelforge.operators import linear as LN
from panelforge.operators import search as SE
from panelforge.operators import trees as TR
from panelforge.session import scratch_path


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 100, 3]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + x[:, 0] * x[:, 2] + rng.normal(0, 0.1, 400)
    rows = [(i, i % 5, *map(float, r), float(t), float(1 + i % 3)) for i, (r, t) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "k int, fold int, a double, b double, c double, y double, w double").repartition(6).cache()
    d.count()
    return d, np.array(rows)


def _ridge(X, y, w, alpha):
    A = X.T @ (X * w[:, None]) + alpha * np.diag([0.0] + [1.0] * (X.shape[1] - 1))
    return np.linalg.solve(A, X.T @ (w * y))


def _design(rows, degree, stats):
    z = {c: (rows[:, 2 + i] - stats.center[c]) / stats.scale[c] for i, c in enumerate("abc")}
    return np.column_stack([np.prod([z[c] for c in t], axis=0) if t else np.ones(len(rows)) for t in LN.monomials("abc", degree)])


@pytest.mark.parametrize("degree, weight", [(1, None), (2, None), (2, "w")])
def test_one_fit_equals_numpy(table, degree, weight):
    d, rows = table
    fit = LN.fit_ridge(d, ["a", "b", "c"], "y", degree, 0.5, weight)
    X = _design(rows, degree, fit.stats)
    want = _ridge(X, rows[:, 5], rows[:, 6] if weight else np.ones(len(rows)), 0.5)
    assert fit.coefficients == pytest.approx(want, rel=1e-9)
    got = {r["k"]: r["prediction"] for r in fit.predict(d).collect()}
    assert [got[int(k)] for k in rows[:, 0]] == pytest.approx(list(X @ want), rel=1e-9)


def test_search_equals_separate_fits_and_reads_once(table, monkeypatch):
    d, rows = table
    calls = []
    inner = LN.fold_sums
    monkeypatch.setattr(LN, "fold_sums", lambda *a, **k: calls.append(1) or inner(*a, **k))
    fit, scores = LN.ridge_search(d, ["a", "b", "c"], "y", (1, 2), (0.1, 10.0))
    assert len(calls) == 1 and len(scores) == 4
    for s in scores:
        r2 = []
        X = _design(rows, s["degree"], fit.stats)
        for f in range(5):
            out = rows[:, 1] == f
            b = _ridge(X[~out], rows[~out, 5], np.ones((~out).sum()), s["alpha"])
            e = rows[out, 5] - X[out] @ b
            r2.append(1 - (e @ e) / ((rows[out, 5] - rows[out, 5].mean()) ** 2).sum())
        assert (s["mean_r2"], s["std_r2"]) == pytest.approx((np.mean(r2), np.std(r2)), abs=1e-9)
    assert fit.info["mean_r2"] == max(s["mean_r2"] for s in scores)


def test_rows_with_gaps_are_left_out(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0), (5.0, None), (float("nan"), 3.0)], "a double, y double")
    sums = LN.fold_sums(d, ["a"], "y")
    assert sums.rows == {0: 3} and LN.solve(sums.total(), [0, 1], 0.0) == pytest.approx([0.0, 2.0], abs=1e-9)


def _tree_by_hand(X, y, w, edges, depth):
    """Predictions of one tree grown by trying every split of every node."""
    bins = np.column_stack([(X[:, [f]] > np.array(edges[f])).sum(axis=1) for f in range(X.shape[1])])
    whole, node = np.floor(y * TR.STEP), np.ones(len(y), int)
    for level in range(depth):
        for n in range(2**level, 2 ** (level + 1)):
            here = node == n
            best = (0.0, None)
            for f, b in itertools.product(range(X.shape[1]), range(bins.max() + 1)):
                left = here & (bins[:, f] <= b)
                right = here & ~left
                if w[left].sum() and w[right].sum():
                    s = [(whole[m] * w[m]).sum() for m in (left, right, here)]
                    gain = s[0] * s[0] / w[left].sum() + s[1] * s[1] / w[right].sum() - s[2] * s[2] / w[here].sum()
                    if gain > best[0]:
                        best = gain, (f, b)
            if best[1]:
                node = np.where(here, 2 * node + (bins[:, best[1][0]] > best[1][1]), node)
    return np.array([(whole[node == n] * w[node == n]).sum() / w[node == n].sum() / TR.STEP for n in node])


def test_one_tree_equals_trying_every_split(table):
    d, rows = table
    model = TR.fit_forest(d, ["a", "b", "c"], "y", ["k"], trees=1, depth=4, bins=8, n_features=3, bootstrap=False)
    want = _tree_by_hand(rows[:, 2:5], rows[:, 5], np.full(400, float(TR.WEIGHT_STEP)), model.edges, 4)
    got = {r["k"]: r["prediction"] for r in TR.score_by_nodes(d, model, ["k"]).collect()}
    assert [got[int(k)] for k in rows[:, 0]] == pytest.approx(list(want), abs=1e-12)


def test_forests_do_not_depend_on_partitions(spark, table):
    d, _ = table
    settings = dict(trees=5, depth=3, bins=8, seed=3)
    one = TR.fit_forest(d.repartition(1), ["a", "b", "c"], "y", ["k"], **settings)
    two = TR.fit_forest(d.repartition(13), ["a", "b", "c"], "y", ["k"], **settings)
    assert sorted(one.nodes) == sorted(two.nodes) and one.trees == 5
    path = scratch_path(spark, "nodes")
    TR.save_nodes(one, spark, path)
    back = TR.load_nodes(spark, path)
    assert sorted(back.nodes) == sorted(one.nodes) and back.edges == one.edges and back.rate is None
    shares = TR.importances(one, spark).collect()
    assert sum(r["importance"] for r in shares) == pytest.approx(1.0)


def test_boosting_lowers_the_error_and_stops(table):
    d, rows = table
    error = lambda m: TR.score_by_nodes(d, m, ["k"]).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    model = TR.fit_boosted(d, ["a", "b", "c"], "y", ["k"], iterations=8, depth=3, rate=0.3, bins=16)
    errors = [error(model.first(n)) for n in (1, 4, 8)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.5 * rows[:, 5].var()
    early = TR.fit_boosted(d, ["c"], "y", ["k"], iterations=30, depth=3, rate=0.5, on=F.col("fold") != 0, validate_on=F.col("fold") == 0, patience=2)
    assert early.trees < 30


def test_odd_rows_of_trees(spark):
    rows = [(1, None, 1.0), (2, float("nan"), 1.0), (3, 5.0, 9.0), (4, 6.0, 9.0), (5, 7.0, None)]
    d = spark.createDataFrame(rows, "k int, a double, y double")
    model = TR.fit_forest(d, ["a"], "y", ["k"], trees=1, depth=2, bins=4, bootstrap=False)
    got = {r["k"]: r["prediction"] for r in TR.score_by_nodes(d, model, ["k"]).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == 9.0 > got[1]


def test_importance_is_one_pass_and_ranks_columns(table):
    d, _ = table
    calls = []

    def score(rows, keys):
        calls.append(keys)
        return rows.withColumn("prediction", 3 * F.col("a") - F.col("b"))

    label = d.withColumn("y", 3 * F.col("a") - F.col("b"))
    got = IM.permutation_importance(label, ["a", "b", "c"], "y", ["k"], score, repeats=4, blocks=3).collect()
    assert calls == [["k", "repeat", "variant"]]
    by = {r["feature"]: r["mean_r2_drop"] for r in got}
    assert by["c"] == 0.0 and by["b"] > by["a"] > 0
    lent = IM.partners(d, ["k"], ["a"], 2, blocks=3)
    for r in (0, 1):
        mine = lent.where(F.col("repeat") == r).select("lent.a")
        assert sorted(x[0] for x in mine.collect()) == sorted(x[0] for x in d.select("a").collect())


def test_search_resumes_where_it_stopped(spark, table):
    d, _ = table
    log, calls = SE.SearchLog(spark, scratch_path(spark, "log")), []

    def fit(train, held, setting):
        calls.append(setting)
        if len(calls) == 7:
            raise RuntimeError("lost")
        return {"n": held.count(), "r2": -abs(setting["x"] - 2), "rmse": 1.0}

    settings = SE.grid(x=[1, 2, 3])
    with pytest.raises(RuntimeError):
        SE.run_search(log, d, "fold", settings, fit, parallelism=1)
    done = len(log.names())
    assert 6 <= done < 15
    assert SE.run_search(log, d, "fold", settings, fit, parallelism=3) == 15 - done
    assert SE.run_search(log, d, "fold", settings, fit) == 0
    table_ = SE.summary(log, settings, "", range(5))
    assert SE.best_setting(table_) == {"x": 2}
    assert {(r["folds"], r["n"]) for r in table_.collect()} == {(5, 400)}
    assert SE.run_search(log, d, "fold", settings[:1], lambda *a: {"n": 1, "r2": 0, "rmse": 0}, data="other") == 5
    assert SE.around({"x": 2, "a": 0.5, "s": "k"}, {"x": (-2, 0, 1), "a": (0.5, 2.0)}) == SE.grid(x=[1, 2, 3], a=[0.25, 1.0], s=["k"])
    assert SE.drawn(settings, 2, 1) == SE.drawn(settings, 2, 1) and len(SE.drawn(settings, 9)) == 3


def test_stacking_weights_are_optimal_at_any_scale():
    rng = np.random.default_rng(8)
    for scale in (1e-4, 1.0, 1e6):
        for m in (2, 4):
            y = rng.normal(5, 1, 300) * scale
            Z = np.column_stack([y + rng.normal(0, 0.5 * (k + 1), 300) * scale for k in range(m)])
            A, b = Z.T @ Z / 300, Z.T @ y / 300
            cost = lambda w: w @ A @ w - 2 * b @ w + 0.1 * w @ w
            w = H._simplex_qp(A, b, 0.1)
            assert w.min() >= 0 and w.sum() == pytest.approx(1)
            for other in rng.dirichlet(np.ones(m), 300):
                assert cost(w) <= cost(0.05 * other + 0.95 * w) + 1e-9 * abs(cost(w))
