"""Pieces on ``pyspark.ml`` and column builders for models (M13-M16, M19, M20,
M22, M31, M39). Linear fits, tree ensembles, neighbours, importances and searches
have modules of their own: ``linear``, ``trees``, ``neighbours``, ``importance``, ``search``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import mlprep


def assembler(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


# M13-M16 ------------------------------------------------------------------------
@dataclass
class PcaResult:
    model: object
    cols: list[str]
    stats: mlprep.Stats
    loadings: np.ndarray         # n_features x k, sign-fixed
    signs: np.ndarray
    explained: list[float]

    def loadings_df(self, spark) -> DataFrame:
        rows = [(j + 1, self.cols[i], float(self.loadings[i, j]))
                for j in range(self.loadings.shape[1]) for i in range(len(self.cols))]
        return spark.createDataFrame(rows, "component int, feature string, loading double")

    def variance_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(self.explained)],
                                     "component int, variance_ratio double")

    def scores(self, df: DataFrame, keep: Sequence[str] = (), prefix: str = "pc") -> DataFrame:
        """Centred (and scaled) projections, sign-fixed."""
        d = mlprep.transform(df, self.stats)
        d = assembler(self.cols, "__x").setHandleInvalid("skip").transform(d)
        t = self.model.transform(d)
        return t.select(*keep, vector_to_array(t["__pca"]).alias("__a")).select(
            *keep, *[(F.col("__a")[j] * F.lit(float(self.signs[j]))).alias(f"{prefix}{j + 1}")
                     for j in range(len(self.signs))])


def pca(df: DataFrame, cols: Sequence[str], k: int, scale: bool = True, fit_on: Column | None = None) -> PcaResult:
    """Centre first (Spark's PCA does not centre in transform),
    scale by the population std when ``scale``; each component's sign is
    fixed so its largest absolute loading is positive."""
    cols = list(cols)
    st = mlprep.fit_standard(df, cols, fit_on)
    if not scale:
        st.scale = {c: 1.0 for c in cols}
    d = mlprep.transform(df.where(fit_on) if fit_on is not None else df, st)
    d = assembler(cols, "__x").setHandleInvalid("skip").transform(d)
    model = PCA(k=k, inputCol="__x", outputCol="__pca").fit(d)
    pc = model.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    signs[signs == 0] = 1.0
    return PcaResult(model, cols, st, pc * signs, signs, [float(x) for x in model.explainedVariance.toArray()])


def pca_loadings(res: PcaResult, spark, n: int = 10) -> DataFrame:
    """Top absolute loadings per component."""
    d = res.loadings_df(spark)
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# M19, M20 -----------------------------------------------------------------------
def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, out: str = "poly") -> DataFrame:
    """Polynomial expansion of the assembled features."""
    d = assembler(cols, "__x").transform(df)
    return PolynomialExpansion(degree=degree, inputCol="__x", outputCol=out).transform(d).drop("__x")


def interactions(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Interaction-only degree 2 -- originals plus pairwise products."""
    pairs = list(itertools.combinations(cols, 2))
    names = [f"{a}_x_{b}" for a, b in pairs]
    return df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in zip(names, pairs)}), list(cols) + names


# M22 ----------------------------------------------------------------------------
def forest(cols: Sequence[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42,
           weight: str | None = None) -> Pipeline:
    """Spark's own random forest, for searches over its settings."""
    rf = RandomForestRegressor(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
                               featureSubsetStrategy="auto")
    if weight:
        rf.setWeightCol(weight)
    return Pipeline(stages=[assembler(cols, "__x"), rf])


# M31 ----------------------------------------------------------------------------
def band_importance(imp: DataFrame, n: int, must_have: Sequence[str] = (), sep: str = "_m") -> DataFrame:
    """Importances of flattened (band, month) features summed per band
    (name before ``sep``), top ``n`` bands, plus the must-have bands."""
    per = imp.groupBy(F.substring_index("feature", sep, 1).alias("band")).agg(F.sum("importance").alias("importance"))
    top = per.orderBy(F.desc("importance"), "band").limit(n).select("band")
    if must_have:
        extra = imp.sparkSession.createDataFrame([(m,) for m in must_have], "band string")
        top = top.unionByName(extra).distinct()
    return top


# M39 ----------------------------------------------------------------------------
def random_fourier(df: DataFrame, cols: Sequence[str], n_features: int = 100, gamma: float = 0.1,
                   seed: int = 42, prefix: str = "rff") -> tuple[DataFrame, list[str]]:
    """Random Fourier features approximating the RBF kernel
    exp(-gamma |x - y|^2): ``sqrt(2/D) cos(w.x + b)``, w ~ N(0, 2 gamma),
    b ~ U(0, 2 pi); seeded, built as native expressions."""
    rng = np.random.default_rng(seed)
    W = rng.normal(scale=math.sqrt(2 * gamma), size=(n_features, len(cols)))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)
    names = [f"{prefix}{i}" for i in range(n_features)]
    exprs = {}
    for i, nme in enumerate(names):
        lin = sum((F.col(c) * F.lit(float(W[i, j])) for j, c in enumerate(cols)), F.lit(float(b[i])))
        exprs[nme] = F.lit(scale) * F.cos(lin)
    return df.withColumns(exprs), names
