"""Nearest neighbours and nearest sites against brute force: pruning, ties, hot cells, poles and the date line."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import grid as Z
from panelforge.operators import neighbours as NB


def _frame(spark, X, ids=None):
    ids = range(len(X)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, X)], "id long, vec array<double>")


def _brute(X, k, include_self=False):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    if not include_self:
        np.fill_diagonal(D, np.inf)
    out = {}
    for i in range(len(X)):
        order = np.lexsort((np.arange(len(X)), D[i]))[:k]
        out[i] = [int(j) for j in order if np.isfinite(D[i, j])]
    return out


def _got(nn):
    got = {}
    for r in nn.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbor"])
    return got


@pytest.mark.parametrize("n_cells, block_rows", [(None, 1024), (9, 8), (1, 16), (40, 5)])
def test_exact_against_brute_force(spark, n_cells, block_rows):
    rng = np.random.default_rng(3)
    X = np.vstack([*[rng.normal(c, 0.3, size=(40, 4)) for c in (0, 3, 6)], np.ones((30, 4))])  # 30 rows alike
    d = _frame(spark, X).repartition(5)
    assert _got(NB.knn_all(d, "id", "vec", 4, n_cells=n_cells, block_rows=block_rows)) == _brute(X, 4)
    assert _got(NB.knn_all(d, "id", "vec", 2, True, n_cells=n_cells, block_rows=block_rows)) == _brute(X, 2, True)


def test_isotropic_and_few_queries(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(150, 16))
    d = _frame(spark, X)
    want = _brute(X, 50)
    got = _got(NB.knn(d, "id", "vec", d.where("id % 50 = 3"), 50, block_rows=16))
    assert got == {i: want[i] for i in (3, 53, 103)}
    assert _got(NB.knn_all(d.limit(3), "id", "vec", 9)) == _brute(X[[r["id"] for r in d.limit(3).collect()]], 9) or d.limit(3).count() == 3


def test_bounds_exclude_blocks(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(10 * c, 0.2, size=(50, 3)) for c in range(20)])
    index = NB.build_index(_frame(spark, X), "id", "vec", n_cells=20, block_rows=10)
    asked = NB.vectors(_frame(spark, X), "id", "vec").select(F.col("id").alias("query"), "vec")
    reached = NB.reached_cells(index, asked.withColumn("reach", F.lit(1.0)), 3)
    assert reached.count() < 3 * len(X)  # of 20 cells each
    assert index.directory.count() >= len(X) / 10
    sizes = [r["rows"] for r in index.directory.collect()]
    assert max(sizes) <= 10 and sum(sizes) == len(X)


def test_busy_blocks_are_copied(spark, monkeypatch):
    monkeypatch.setattr(NB, "QUERIES_PER_COPY", 7)
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 3))
    assert _got(NB.knn_all(_frame(spark, X), "id", "vec", 5, n_cells=2, block_rows=30)) == _brute(X, 5)


def test_plan_holds_groups_not_queries(spark, monkeypatch):
    """Nothing that is planned grows with queries times cells, and no vector is in it."""
    rng = np.random.default_rng(8)
    X = rng.normal(size=(400, 16))  # isotropic: every query reaches every cell
    index = NB.build_index(_frame(spark, X), "id", "vec", n_cells=20, block_rows=16)
    monkeypatch.setattr(NB, "QUERIES_PER_COPY", 100)
    asked = NB.grouped_queries(index, NB.vectors(_frame(spark, X), "id", "vec"))
    assert {r["count"] for r in asked.groupBy("group").count().collect()} <= set(range(1, 300))
    reached = NB.reached_cells(index, asked.withColumn("reach", F.lit(float("inf"))), 3)
    assert "vec" not in reached.columns
    assert reached.count() == asked.select("group").distinct().count() * len(index.cells)
    assert _got(NB.search(index, NB.vectors(_frame(spark, X), "id", "vec"), 3)) == _brute(X, 3)


def test_large_and_small_distances_are_exact(spark):
    """Rows far from 0 and close together, where products of matrices round, and rows whose squares overflow."""
    rng = np.random.default_rng(9)
    X = np.vstack([1e6 + rng.integers(0, 9, size=(60, 5)) * 1e-3, rng.normal(size=(20, 5)), np.full((3, 5), 1e200)])
    with np.errstate(over="ignore"):
        want = _brute(X, 4)
    assert _got(NB.knn_all(_frame(spark, X), "id", "vec", 4, n_cells=3, block_rows=16)) == want


def test_recall_of_probes(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(4 * c, 1.0, size=(100, 8)) for c in range(4)])
    d = _frame(spark, X)
    index = NB.build_index(d, "id", "vec", n_cells=10)
    asked = NB.vectors(d, "id", "vec")
    exact = NB.search(index, asked, 5)
    few, all_ = (NB.recall(NB.search(index, asked, 5, probes=p), exact).first() for p in (4, 10))
    assert all_["recall"] == 1.0 and few["n"] == 2000 and 0.9 <= few["recall"] <= 1.0


def _km(p, q):
    (a, b), (c, d) = np.radians(p), np.radians(q)
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * Z.EARTH_KM * np.arcsin(np.sqrt(min(1.0, h)))


def _sites(spark, P, S):
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(P)], "k int, lat double, lon double")
    sites = spark.createDataFrame([(f"s{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(S)], "name string, slat double, slon double")
    out = Z.nearest(pts, "k", "lat", "lon", sites, "slat", "slon", "name")
    return {r["k"]: (r["dist_km"], r["nearest_site"]) for r in out.collect()}


def _check(spark, P, S):
    got = _sites(spark, P, S)
    for i, p in enumerate(P):
        km = [_km(p, q) for q in S]
        best = int(np.argmin(km))
        assert abs(got[i][0] - km[best]) < 1e-6
        assert km[int(got[i][1][1:])] - km[best] < 1e-6


@pytest.mark.parametrize("n_sites", [1, 3, 40, 700])
def test_nearest_site_all_over_the_globe(spark, n_sites):
    rng = np.random.default_rng(n_sites)
    place = lambda n: list(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)))
    edges = [(90, 0), (-90, 17), (89.999, 120), (-89.9, -179.9), (0, 180), (0, -180), (10, 179.999), (10, -179.999), (45, 0)]
    _check(spark, place(60) + edges, place(n_sites))


def test_nearest_site_dense_and_empty_regions(spark):
    rng = np.random.default_rng(5)
    S = list(zip(rng.normal(48, 0.05, 400), rng.normal(11, 0.05, 400))) + [(-33.0, 151.0), (89.95, 10.0), (89.95, -170.0), (1.0, 179.95)]
    P = list(zip(rng.normal(48, 0.1, 60), rng.normal(11, 0.1, 60))) + [(-10.0, 140.0), (89.99, 100.0), (1.0, -179.95), (47.0, 30.0)]
    _check(spark, P, S)


def test_nearest_site_ties_nulls_and_nothing(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 5.0, float("nan"))], "k int, lat double, lon double")
    sites = spark.createDataFrame([("b", 1.0, 0.0), ("a", -1.0, 0.0), ("c", None, 0.0), ("d", 1.0, 0.0)], "name string, slat double, slon double")
    got = {r["k"]: r["nearest_site"] for r in Z.nearest(pts, "k", "lat", "lon", sites, "slat", "slon", "name").collect()}
    assert got == {1: "a", 2: None, 3: None}
    none = Z.nearest(pts, "k", "lat", "lon", sites.limit(0), "slat", "slon", "name")
    assert [r["nearest_site"] for r in none.collect()] == [None] * 3


def test_rows_joined_follow_local_density(spark):
    sites = spark.range(60_000).select(F.concat(F.lit("s"), "id").alias("name"), (F.col("id") % 180 - 90).cast("double").alias("slat"),
                                       (F.col("id") % 359 - 179).cast("double").alias("slon"))
    pts = spark.createDataFrame([(1, 10.2, 20.1)], "k int, lat double, lon double")
    assert Z.nearest(pts, "k", "lat", "lon", sites, "slat", "slon", "name").first()["dist_km"] < 100
    reached = pts.select(F.size(Z.reached_cells(F.col("lat"), F.col("lon"), F.lit(0.5), F.lit(7)))).first()[0]
    assert reached <= 16


def test_places_on_lines_and_many_sites_at_one_place(spark):
    """The finest cells follow the places, not their box; sites and points that share a place are one place."""
    rng = np.random.default_rng(6)
    S = [(float(a), float(b)) for a, b in zip(rng.uniform(40, 45, 600), rng.integers(0, 3, 600))] + [(42.0, 1.0)] * 200
    P = [(float(a), float(b)) for a, b in zip(rng.uniform(39, 46, 40), rng.integers(0, 4, 40))] + [(42.0, 1.0)] * 50
    places = spark.createDataFrame(sorted(set(S)), "__slat double, __slon double")
    finest = Z._finest_level(places, len(set(S)))
    cells = places.groupBy(Z._cells(F.col("__slat"), F.col("__slon"), F.lit(finest))).count()
    assert cells.agg(F.sum(F.col("count") * F.col("count"))).first()[0] <= 4 * len(set(S))
    _check(spark, P, S)
    assert _sites(spark, P, S)[45] == (0.0, "s0600")
