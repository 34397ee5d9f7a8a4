"""Linear fits from additive fold statistics.

Squares and products of all terms are summed once per fold. Everything else follows from these small
matrices: the training statistics of a fold are the sum of the other folds', a lower degree is a
submatrix, a penalty is added on the diagonal, and held-out errors are quadratic forms of the held-out
fold. A whole ridge search over degrees, penalties and folds so reads the data once (after the
pass that scales the columns), and weights only change the sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import mlprep


def monomials(cols: Sequence[str], degree: int) -> list[tuple[str, ...]]:
    """Products of the columns up to a degree, lower degrees first; ``()`` is the intercept."""
    return [t for d in range(degree + 1) for t in itertools.combinations_with_replacement(cols, d)]


def term_name(term: Sequence[str]) -> str:
    return "*".join(term) if term else "intercept"


@dataclass
class FoldSums:
    """Per fold the weighted sums ``X'WX`` with the target as last column of ``X``, over ``terms``."""

    terms: list[tuple[str, ...]]
    folds: dict[int, np.ndarray]
    rows: dict[int, int]

    def total(self, without: int | None = None) -> np.ndarray:
        size = len(self.terms) + 1
        return sum((m for f, m in self.folds.items() if f != without), np.zeros((size, size)))


def fold_sums(df: DataFrame, cols: Sequence[str], label: str, degree: int = 1, fold: str | None = None,
              weight: str | None = None) -> FoldSums:
    """The sums of all folds in one pass. Rows with NULL or NaN in a used column are left out.

    Each task adds up its Arrow batches and writes one row per fold and pair of terms; Spark adds
    those by (fold, pair), and only terms x terms numbers per fold reach the driver."""
    cols = list(cols)
    terms = monomials(cols, degree)
    size = len(terms) + 1
    used = [*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(f"`{label}`").cast("double").alias("y"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold")]
    upper = np.triu_indices(size)

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            data = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in batch.schema.names[:-1]])
            folds = batch.column("fold").to_numpy(zero_copy_only=False).astype(float)
            real = ~np.isnan(data).any(axis=1) & ~np.isnan(folds)
            data, folds = data[real], folds[real].astype(int)
            x = dict(zip(cols, data.T))
            full = np.column_stack([*[np.prod([x[c] for c in t], axis=0) if t else np.ones(len(data)) for t in terms], data[:, -2]])
            for f in np.unique(folds):
                mine = folds == f
                part = full[mine].T @ (full[mine] * data[mine, -1:])
                sums[f] = sums.get(f, 0) + part
                counts[f] = counts.get(f, 0) + int(mine.sum())
        for f, m in sums.items():
            n = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int32)), pa.array(upper[0].astype(np.int32)),
                                              pa.array(upper[1].astype(np.int32)), pa.array(m[upper]),
                                              pa.array(np.full(n, counts[f], np.int64))], names=["fold", "i", "j", "s", "n"])

    parts = df.select(*used).mapInArrow(add_up, "fold int, i int, j int, s double, n long")
    folds, rows = {}, {}
    for r in parts.groupBy("fold", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        m = folds.setdefault(r["fold"], np.zeros((size, size)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
        rows[r["fold"]] = r["n"]
    return FoldSums(terms, folds, rows)


def solve(sums: np.ndarray, kept: Sequence[int], alpha: float) -> np.ndarray:
    """Ridge coefficients of the kept terms: ``(X'WX + alpha I) b = X'Wy``, the intercept (term 0) not penalised."""
    kept = list(kept)
    a = sums[np.ix_(kept, kept)] + alpha * np.diag([0.0 if i == 0 else 1.0 for i in kept])
    return np.linalg.lstsq(a, sums[kept, -1], rcond=None)[0]


def held_out(sums: np.ndarray, kept: Sequence[int], b: np.ndarray) -> dict[str, float]:
    """Errors on the rows behind ``sums``: ``(y - Xb)'W(y - Xb)`` and what follows from it."""
    kept = list(kept)
    sse = max(0.0, sums[-1, -1] - 2 * b @ sums[kept, -1] + b @ sums[np.ix_(kept, kept)] @ b)
    weight = sums[0, 0]
    spread = sums[-1, -1] - sums[0, -1] ** 2 / weight if weight else 0.0
    return {"n": weight, "rmse": float(np.sqrt(sse / weight)) if weight else float("nan"),
            "r2": 1 - sse / spread if spread > 0 else float("nan")}


@dataclass
class LinearFit:
    """Coefficients of ``terms`` over columns scaled by ``stats``."""

    terms: list[tuple[str, ...]]
    coefficients: np.ndarray
    stats: mlprep.Stats | None = None
    info: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Native expressions over the original columns."""
        def scaled(c: str) -> Column:
            x = F.col(f"`{c}`").cast("double")
            return (x - F.lit(float(self.stats.center[c]))) / F.lit(float(self.stats.scale[c])) if self.stats else x

        total = F.lit(0.0)
        for term, b in zip(self.terms, self.coefficients, strict=True):
            product = F.lit(float(b))
            for c in term:
                product = product * scaled(c)
            total = total + product
        return df.withColumn(out, total)

    def coefficients_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(term_name(t), float(b)) for t, b in zip(self.terms, self.coefficients)], "term string, coefficient double")


def fit_ridge(df: DataFrame, cols: Sequence[str], label: str, degree: int = 1, alpha: float = 1.0,
              weight: str | None = None, scale: bool = True) -> LinearFit:
    """One (weighted) ridge fit. ``alpha`` is the penalty on the squared coefficients of the scaled terms,
    added to the sum of squared errors as it is (not divided by the number of rows)."""
    stats = mlprep.fit_standard(df, cols) if scale else None
    sums = fold_sums(mlprep.transform(df, stats) if stats else df, cols, label, degree, weight=weight)
    return LinearFit(sums.terms, solve(sums.total(), range(len(sums.terms)), alpha), stats, {"degree": degree, "alpha": alpha})


def ridge_search(df: DataFrame, cols: Sequence[str], label: str, degrees: Sequence[int] = (1, 2, 3),
                 alphas: Sequence[float] = (0.1, 1.0, 10.0), fold: str = "fold", weight: str | None = None,
                 stats: mlprep.Stats | None = None) -> tuple[LinearFit, list[dict]]:
    """Ridge over degrees and penalties by k-fold cross-validation, from one ``fold_sums``.

    Columns are scaled by ``stats`` (of all rows, unless given). Returns the fit on all rows with
    the best mean held-out R2 (ties: lower degree, then larger penalty) and one row per setting
    with mean and population deviation of R2 and RMSE over the folds."""
    stats = stats or mlprep.fit_standard(df, cols)
    sums = fold_sums(mlprep.transform(df, stats), cols, label, max(degrees), fold, weight)
    table = []
    for degree, alpha in itertools.product(degrees, alphas):
        kept = [i for i, t in enumerate(sums.terms) if len(t) <= degree]
        scores = [held_out(sums.folds[f], kept, solve(sums.total(without=f), kept, alpha)) for f in sorted(sums.folds)]
        r2, rmse = (np.array([s[m] for s in scores]) for m in ("r2", "rmse"))
        table.append({"degree": degree, "alpha": float(alpha), "mean_r2": float(r2.mean()), "std_r2": float(r2.std()),
                      "mean_rmse": float(rmse.mean()), "folds": len(scores)})
    best = max(table, key=lambda r: (r["mean_r2"], -r["degree"], r["alpha"]))
    kept = [i for i, t in enumerate(sums.terms) if len(t) <= best["degree"]]
    fit = LinearFit([sums.terms[i] for i in kept], solve(sums.total(), kept, best["alpha"]), stats, dict(best))
    return fit, table


def coefficient_shares(fit: LinearFit, spark) -> DataFrame:
    """Absolute coefficients of the first-degree terms, and their percent of the sum."""
    each = {t[0]: abs(float(b)) for t, b in zip(fit.terms, fit.coefficients) if len(t) == 1}
    total = sum(each.values()) or 1.0
    rows = [(c, b, 100 * b / total) for c, b in each.items()]
    return spark.createDataFrame(rows, "feature string, abs_coef double, pct double").orderBy(F.desc("pct"), "feature")
