"""Nearest neighbours (M32, M33), exact against brute-force DuckDB twins and
approximate by recall, and the polynomial expansion (M19)."""

from __future__ import annotations

import itertools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelforge.operators import models as M
from panelforge.operators import neighbours as NB
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query

def R(c, n=4):
    return F.round(c, n)


# ---------------------------------------------------------------- kNN
EMB_SQL = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


@query("m32_knn_of_query_points", ops=("M32", "O8"), sql="WITH " + EMB_SQL + """,
q AS (SELECT * FROM e WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
d AS (SELECT q.vec_id AS query, e.vec_id AS neighbor, list_distance(q.v, e.v) AS dist FROM q, e WHERE q.vec_id <> e.vec_id)
SELECT query, CAST(rank AS BIGINT) AS rank, neighbor, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbor) AS rank FROM d) WHERE rank <= 50""")
def m_knn(spark, sf_dir):
    e = P.table(spark, sf_dir, "embeddings")
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    q = e.join(firsts.select("vec_id"), "vec_id", "left_semi")
    nn = NB.knn(e, "vec_id", "embedding", q, k=50)
    return nn.withColumn("dist", R("dist", 6))


@query("m33_knn_distance_profile", ops=("M33",), sql="WITH " + EMB_SQL + """,
d AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, list_distance(a.v, b.v) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbor) AS rank FROM d)
SELECT CAST(rank AS BIGINT) AS rank, round(avg(dist), 6) AS mean_dist, CAST(count(*) AS BIGINT) AS n FROM r WHERE rank <= 10 GROUP BY rank""")
def m_knn_profile(spark, sf_dir):
    nn = NB.knn_all(P.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=10)
    return NB.knn_profile(nn).withColumn("mean_dist", R("mean_dist", 6))


@query("m33_knn_all_points", ops=("M33",), sql="WITH " + EMB_SQL + """,
d AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, list_distance(a.v, b.v) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT query, CAST(rank AS BIGINT) AS rank, neighbor, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbor) AS rank FROM d) WHERE rank <= 3""")
def m_knn_all(spark, sf_dir):
    nn = NB.knn_all(P.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=3)
    return nn.withColumn("dist", R("dist", 6))


@query("m32_approximate_recall", ops=("M32", "M33"), sql="""
SELECT CAST(count(*) * 10 AS BIGINT) AS n, CAST(1 AS BIGINT) AS enough FROM embeddings""")
def m_knn_recall(spark, sf_dir):
    """The approximate mode against the exact result, for all rows as queries: its recall is 0.9 or more."""
    e = P.table(spark, sf_dir, "embeddings")
    asked = NB.vectors(e, "vec_id", "embedding")
    exact = NB.search(NB.build_index(e, "vec_id", "embedding"), asked, 10)
    near = NB.search(NB.build_index(e, "vec_id", "embedding", n_cells=8, copies=2), asked, 10, probes=5)
    return NB.recall(near, exact).select("n", (F.col("recall") >= 0.9).alias("enough"))


# ---------------------------------------------------------------- fits
_MONOMIALS = ", ".join(" * ".join(m) for k in (1, 2, 3) for m in itertools.combinations_with_replacement(
    ["CAST(n AS DOUBLE)", "CAST(mo AS DOUBLE)", "CAST(yr AS DOUBLE)"], k))


@query("m19_polynomial_expansion", ops=("M19",), sql=Q.with_(Q.PANEL) + f"""
, t AS (SELECT entity, yr, mo, list_sort([{_MONOMIALS}]) AS terms FROM panel)
SELECT entity, yr, mo, CAST(k AS BIGINT) AS k, terms[k + 1] AS term FROM t, range(19) AS r(k)""")
def m_poly(spark, sf_dir):
    d = M.polynomial(P.base_panel(spark, sf_dir), ["n", "mo", "yr"], degree=3)
    terms = F.array_sort(vector_to_array("poly"))
    return d.select("entity", "yr", "mo", F.posexplode(terms).alias("k", "term"))


