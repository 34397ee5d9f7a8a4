"""Tree ensembles as node tables.

All trees of a forest grow together, one level per pass. Rows hold their bins (exact quantile edges of each
feature); a task finds its rows' nodes, adds up counts and target sums by (tree, node, feature, bin) in
Arrow batches, and Spark adds up the tasks' sums and picks each node's best split. Only splits reach the driver, at
most trees x 2**depth of them, whatever the number of rows. The model is the table of its
nodes, so scoring is a join of rows to nodes, level by level, and any SQL engine can do it.

Sums are of whole numbers (targets in steps of 2**-20, weights in steps of 2**-10), bootstrap weights and feature
draws come from hashes: the same rows give the same trees however they are partitioned, and
after lost executors too. The split of a node is the one that lowers the squared error most; ties go to
the feature that is named first, then to the lower bin. A NULL or NaN feature value falls into the lowest bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order_stats import quantiles_by_column
from panelforge.session import cut_lineage, ship

STEP, WEIGHT_STEP = 2**20, 2**10
#: A row weighs 0, 1, 2, ... in a tree as its draw lies below the Poisson(1) distribution, in steps of 2**-32.
POISSON = [int(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) * 2**32) for n in range(7)]
SPREAD = 2654435761


def tree_constants(tree: int, seed: int) -> tuple[int, int]:
    """Factor and addend of a tree's draws from a row's hash."""
    return (SPREAD * (2 * (tree + seed) + 1)) % 2**31 | 1, (40503 * (tree + seed) ** 2 + 12345) % 2**32


def draw_weights(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    a, c = tree_constants(tree, seed)
    return np.searchsorted(POISSON, (hashes * a + c) % 2**32, side="right")


def feature_draw(tree: Column, node: Column, feature: Column, seed: int) -> Column:
    return F.pmod((tree * 7919 + node * 104729 + (feature + 1) * 1299709 + seed) * F.lit(SPREAD).cast("long"), F.lit(2**32).cast("long"))


@dataclass
class TreeModel:
    """``nodes``: (tree, node, feature, split, threshold, weight, total, gain); node 1 is the root, 2k and 2k + 1 the
    children of k; a leaf has feature -1. A leaf's value is ``total / weight / STEP``."""

    features: list[str]
    edges: list[list[float]]
    depth: int
    nodes: list[tuple] = field(default_factory=list)
    base: float = 0.0
    rate: float | None = None  # None: the mean over the trees; else base + rate x the sum

    @property
    def trees(self) -> int:
        return len({n[0] for n in self.nodes})

    def nodes_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.nodes, "tree int, node int, feature int, split int, threshold double, weight long, total long, gain double")

    def combined(self, total: Column) -> Column:
        return total / F.lit(float(self.trees)) if self.rate is None else F.lit(self.base) + F.lit(self.rate) * total

    def first(self, trees: int) -> TreeModel:
        return TreeModel(self.features, self.edges, self.depth, [n for n in self.nodes if n[0] < trees], self.base, self.rate)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    cuts = quantiles_by_column(df, list(features), [i / bins for i in range(1, bins)])
    return [sorted({x for x in cuts[f] if x is not None and math.isfinite(x)}) for f in features]


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """The number of edges below ``x``; 0 for NULL and NaN."""
    x = F.nanvl(x.cast("double"), F.lit(None))
    return F.coalesce(sum(((x > F.lit(float(e))).cast("int") for e in edges), F.lit(0)), F.lit(0))


class _Walker:
    """The nodes as arrays, to send rows down the trees."""

    def __init__(self, nodes: Sequence[tuple], trees: int, depth: int):
        self.feature = np.full((trees, 2 ** (depth + 1)), -1, np.int32)
        self.split = np.zeros_like(self.feature)
        self.value = np.zeros(self.feature.shape)
        for tree, node, feature, split, _, weight, total, _ in nodes:
            self.feature[tree, node], self.split[tree, node] = feature, split
            self.value[tree, node] = total / weight / STEP if weight else 0.0
        self.depth = depth

    def walk(self, bins: np.ndarray, tree: int) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for _ in range(self.depth):
            feature = self.feature[tree, at]
            go = feature >= 0
            right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.split[tree, at]
            at = np.where(go, 2 * at + right, at)
        return at


def prepared(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], edges: list, weight: str | None,
             on: Column | None, seed: int) -> DataFrame:
    """``bins, y, w, h`` of the rows to fit on: bins, target, whole weight, and a 32-bit hash of the keys."""
    d = df.where(on) if on is not None else df
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    w = F.round(F.col(weight) * WEIGHT_STEP).cast("long") if weight else F.lit(WEIGHT_STEP).cast("long")
    bins = F.array(*[bin_of(F.col(f"`{f}`"), e) for f, e in zip(features, edges)])
    d = d.select(bins.alias("bins"), F.col(label).cast("double").alias("y"), w.alias("w"), h.alias("h"))
    return cut_lineage(d.where(F.col("y").isNotNull() & ~F.isnan("y") & (F.col("w") > 0)))


def _grow(rows: DataFrame, model: TreeModel, trees: Sequence[int], depth: int, seed: int, bootstrap: bool, n_features: int,
          min_weight: int) -> None:
    """Grows the given trees of ``model`` level by level; for boosting the target is what earlier trees leave."""
    new, n_inputs, base, rate = list(trees), len(model.features), model.base, model.rate
    sizes = [len(e) + 1 for e in model.edges]
    done, most = list(model.nodes), 2**depth
    width = max(sizes)
    for level in range(depth):
        walker = _Walker(model.nodes, max(new) + 1, model.depth)
        low = 2**level

        def sums(batches: Iterable[pa.RecordBatch], walker=walker, low=low) -> Iterator[pa.RecordBatch]:
            counts = {t: np.zeros((low, n_inputs, width)) for t in new}
            totals = {t: np.zeros((low, n_inputs, width)) for t in new}
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(n, n_inputs)
                y, w, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "h"))
                if rate is not None:
                    y = y.copy()
                    fitted = np.full(n, base)
                    for t in range(min(new)):
                        fitted = fitted + rate * walker.value[t, walker.walk(bins, t)]
                    y = y - fitted
                whole = np.floor(y * STEP)
                for t in new:
                    at = walker.walk(bins, t)
                    weight = w * draw_weights(h, t, seed) if bootstrap else w
                    here = (at >= low) & (weight > 0)
                    for f in range(n_inputs):
                        cell = (at[here] - low) * width + bins[here, f]
                        counts[t][:, f, :] += np.bincount(cell, weight[here], low * width).reshape(low, width)
                        totals[t][:, f, :] += np.bincount(cell, weight[here] * whole[here], low * width).reshape(low, width)
            for t in new:
                node, f, b = np.nonzero(counts[t])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), t, np.int32)), pa.array((node + low).astype(np.int32)), pa.array(f.astype(np.int32)),
                     pa.array(b.astype(np.int32)), pa.array(counts[t][node, f, b].astype(np.int64)),
                     pa.array(totals[t][node, f, b].astype(np.int64))], names=["tree", "node", "feature", "bin", "n", "s"])

        cells = (rows.mapInArrow(sums, "tree int, node int, feature int, bin int, n long, s long")
                 .groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
        best = best_splits(cells, n_inputs, n_features, min_weight, seed).collect()
        if level == 0:  # the roots
            done += [(r["tree"], 1, -1, 0, None, r["all_n"], r["all_s"], 0.0) for r in best]
        at = {(n[0], n[1]): i for i, n in enumerate(done)}
        for r in best:
            if r["gain"] is None or r["gain"] <= 0:
                continue
            done[at[r["tree"], r["node"]]] = (r["tree"], r["node"], r["feature"], r["bin"], model.edges[r["feature"]][r["bin"]],
                                              r["all_n"], r["all_s"], r["gain"])
            for child, n, s in ((2 * r["node"], r["left_n"], r["left_s"]),
                                (2 * r["node"] + 1, r["all_n"] - r["left_n"], r["all_s"] - r["left_s"])):
                done.append((r["tree"], child, -1, 0, None, n, s, 0.0))
        model.nodes = done
        if not any(r["gain"] is not None and r["gain"] > 0 for r in best) or 2 * low > most:
            break


def best_splits(cells: DataFrame, n_inputs: int, n_features: int, min_weight: int, seed: int) -> DataFrame:
    """One row per (tree, node): the split ``bin`` of ``feature`` (values up to its edge go left) with the largest gain."""
    cells = cells.repartition("tree", "node")  # once for the running sums and the choice
    by_feature = Window.partitionBy("tree", "node", "feature")
    upto = by_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = cells.select("*", F.sum("n").over(upto).alias("left_n"), F.sum("s").over(upto).alias("left_s"),
                     F.sum("n").over(by_feature).alias("all_n"), F.sum("s").over(by_feature).alias("all_s"))
    left, right, whole = (F.col("left_s").cast("double"), (F.col("all_s") - F.col("left_s")).cast("double"), F.col("all_s").cast("double"))
    rest = F.col("all_n") - F.col("left_n")
    gain = left * left / F.col("left_n") + right * right / rest - whole * whole / F.col("all_n")
    may = (F.col("left_n") >= min_weight) & (rest >= min_weight)
    if n_features < n_inputs:
        every = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_inputs - 1)), lambda f: F.struct(
            feature_draw(F.col("tree").cast("long"), F.col("node").cast("long"), f.cast("long"), seed).alias("draw"), f.alias("f"))))
        may = may & F.array_contains(F.transform(F.slice(every, 1, n_features), lambda x: x["f"]), F.col("feature"))
    c = c.withColumn("gain", F.when(may, gain))
    order = F.struct(F.coalesce(-F.col("gain"), F.lit(float("inf"))).alias("a"), "feature", "bin")
    return (c.groupBy("tree", "node").agg(F.min_by(F.struct("gain", "feature", "bin", "left_n", "left_s", "all_n", "all_s"), order).alias("b"))
            .select("tree", "node", "b.*"))


def fit_forest(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], trees: int = 100, depth: int = 8,
               bins: int = 32, n_features: int | None = None, bootstrap: bool = True, min_weight: float = 1.0, weight: str | None = None,
               on: Column | None = None, seed: int = 42) -> TreeModel:
    """A random forest; each node draws ``n_features`` (a third, at least one) of the features. ``keys`` name a row."""
    ship(df.sparkSession)
    fit_on = df.where(on) if on is not None else df
    edges = bin_edges(fit_on, features, bins)
    model = TreeModel(list(features), edges, depth)
    rows = prepared(df, features, label, keys, edges, weight, on, seed)
    drawn = n_features or max(1, len(features) // 3)
    _grow(rows, model, range(trees), depth, seed, bootstrap, drawn, int(min_weight * WEIGHT_STEP))
    return model


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], iterations: int = 50, depth: int = 4,
                rate: float = 0.1, bins: int = 32, min_weight: float = 1.0, weight: str | None = None, on: Column | None = None,
                validate_on: Column | None = None, patience: int = 5, seed: int = 42) -> TreeModel:
    """Each tree is fitted to what the trees before it leave. With ``validate_on`` the trees end
    at the lowest error on those rows, once ``patience`` further trees have not lowered it."""
    ship(df.sparkSession)
    fit_on = df.where(on) if on is not None else df
    edges = bin_edges(fit_on, features, bins)
    model = TreeModel(list(features), edges, depth, rate=rate)
    rows = prepared(df, features, label, keys, edges, weight, on, seed)
    w, s = rows.agg(F.sum("w"), F.sum(F.col("w") * F.floor(F.col("y") * STEP))).first()
    model.base = s / w / STEP if w else 0.0
    held = prepared(df, features, label, keys, edges, None, validate_on, seed) if validate_on is not None else None
    errors: list[float] = []
    for t in range(iterations):
        _grow(rows, model, [t], depth, seed, False, len(features), int(min_weight * WEIGHT_STEP))
        if held is not None:
            errors.append(_squared_error(held, model))
            if t - int(np.argmin(errors)) >= patience:
                break
    return model.first(int(np.argmin(errors)) + 1) if errors else model


def _squared_error(rows: DataFrame, model: TreeModel) -> float:
    walker, trees, base, rate, n_inputs = _Walker(model.nodes, model.trees, model.depth), model.trees, model.base, model.rate, len(model.features)

    def errors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_inputs)
            fitted = np.full(len(bins), base)
            for t in range(trees):
                fitted = fitted + rate * walker.value[t, walker.walk(bins, t)]
            total += float(((batch.column("y").to_numpy(zero_copy_only=False) - fitted) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["e"])

    return rows.mapInArrow(errors, "e double").agg(F.sum("e")).first()[0] or 0.0


def score_by_nodes(df: DataFrame, model: TreeModel, keys: Sequence[str], out: str = "prediction", nodes: DataFrame | None = None) -> DataFrame:
    """Rows joined to the node table level by level, one row per row and tree, then put together by row.

    ``nodes`` may be a stored node table; it is small and AQE sends it along. ``keys`` name a row."""
    keys = list(keys)
    nodes = model.nodes_df(df.sparkSession) if nodes is None else nodes
    one = F.col("total") / F.col("weight") / F.lit(float(STEP))
    table = nodes.select("tree", "node", "feature", "split", one.alias("value"))
    bins = F.array(*[bin_of(F.col(f"`{f}`"), e) for f, e in zip(model.features, model.edges)])
    rows = df.select(*keys, bins.alias("__bins"), F.explode(F.sequence(F.lit(0), F.lit(model.trees - 1))).alias("tree"), F.lit(1).alias("node"))
    for _ in range(model.depth):
        split = table.where("feature >= 0").select("tree", "node", "feature", "split")
        rows = rows.join(split, ["tree", "node"], "left")
        right = (F.get("__bins", F.col("feature")) > F.col("split")).cast("int")
        rows = rows.select(*keys, "__bins", "tree", F.coalesce(2 * F.col("node") + right, F.col("node")).alias("node"))
    values = rows.join(table.select("tree", "node", "value"), ["tree", "node"])
    scores = values.groupBy(*keys).agg(F.sum("value").alias("__total"))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys]
    scores = scores.select(*[F.col(k).alias(f"__{k}") for k in keys], model.combined(F.col("__total")).alias(out))
    both = df.join(scores, on, "left")
    return both.select(*[c for c in df.columns if c != out], out)


def importances(model: TreeModel, spark) -> DataFrame:
    """Share of each feature in the squared error that all splits take away, ranked."""
    total = sum(n[7] for n in model.nodes) or 1.0
    rows = [(f, sum(n[7] for n in model.nodes if n[2] == i) / total) for i, f in enumerate(model.features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_nodes(model: TreeModel, spark, path: str) -> None:
    """The node table and, beside it, what scoring needs to know of the model."""
    model.nodes_df(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(i, f, e, model.depth, model.base, model.rate) for i, (f, e) in enumerate(zip(model.features, model.edges))]
    spark.createDataFrame(about, "i int, feature string, edges array<double>, depth int, base double, rate double").write.mode("overwrite").parquet(f"{path}/model")


def load_nodes(spark, path: str) -> TreeModel:
    about = spark.read.parquet(f"{path}/model").orderBy("i").collect()
    nodes = [tuple(r) for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()]
    return TreeModel([r["feature"] for r in about], [list(r["edges"]) for r in about], about[0]["depth"], nodes, about[0]["base"], about[0]["rate"])
